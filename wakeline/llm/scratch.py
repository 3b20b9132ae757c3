"""Tables that cut lineage, as in the library."""

from wakeline.scratch import Scratch, shared_folder  # noqa: F401
