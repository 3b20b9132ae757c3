"""Connected components, as in the library."""

from wakeline.operators.graph import components  # noqa: F401
