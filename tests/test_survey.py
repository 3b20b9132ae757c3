"""Turning points and survey patterns against plain scans."""

import math
import random

import numpy as np
import pytest

from wakeline.operators import survey as S
from wakeline.operators import turning as T


def plain_turns(s, thr):
    """By the rule itself: from each turn (or the start) find the next extreme that the signal leaves by the threshold."""
    out, i, n = [], 0, len(s)
    j = next((k for k in range(1, n) if abs(s[k] - s[0]) >= thr), None)
    if j is None:
        return out
    up = s[j] > s[0]
    i = j
    while True:
        best, k = i, i + 1
        while k < n:
            ahead = s[k] - s[best] if up else s[best] - s[k]
            if ahead > 0:
                best = k
            elif -ahead >= thr:
                break
            k += 1
        if k >= n:
            return out
        out.append((best, 1 if up else -1))
        up, i = not up, k


def signals():
    rng = random.Random(5)
    for case in range(60):
        n, step = rng.randrange(1, 90), rng.choice([0.04, 0.3, 1.0])
        v, out = 0.0, []
        for _ in range(n):
            v += rng.choice([-2, -1, 0, 1, 2]) * step if case % 3 else rng.gauss(0, step)
            out.append(round(v, 6))
        yield out, rng.choice([0.1, 0.4, 1.0, 2.0])
    yield [float(k) for k in range(50)], 1.0
    yield [0.0] * 30, 1.0
    yield [0.0, 0.4, -0.4, 0.45, -0.5, 0.5, 1.0], 1.0


def test_states_carry_over_every_cut():
    for s, thr in signals():
        v, p = np.array(s), np.arange(len(s))
        whole, end = T.scan(v, p, None, thr)
        assert whole == plain_turns(s, thr)
        for cut in range(1, len(s)):
            turns, state = T.scan(v[:cut], p[:cut], None, thr)
            again, last = T.scan(v[cut:], p[cut:], state, thr)
            assert turns + again == whole and last == end
            assert T.carried(state, T.summary(v[cut:], p[cut:], thr), thr) == end, (s, thr, cut)


def test_turning_points_of_tracks(spark):
    rows, want = [], set()
    for k, (s, thr) in enumerate(signals()):
        if thr != 1.0:
            continue
        rows += [(f"v{k}", i * 700.0, 1000 * k + i, x) for i, x in enumerate(s)]
        want |= {(f"v{k}", 1000 * k + i, kind) for i, kind in plain_turns(s, 1.0)}
    rows += [("v0", None, 1, 2.0), (None, 1.0, 2, 3.0), ("v1", 1.0, 3, None), ("v1", 1.0, 4, float("nan"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "track_id string, t double, event_id long, lat double")
    got = [tuple(r) for r in T.turning_points(df, "lat", 1.0, piece_s=3000.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert T.turning_points(df.limit(0), "lat", 1.0).count() == 0


NM = 1852 / 6_371_008.8


def plain_stretches(track, cfg):
    """Windows one after another over a session's lists, legs by headings, spans merged in a loop."""
    lat0, lon0 = sum(r[1] for r in track) / len(track), sum(r[2] for r in track) / len(track)
    t = [r[0] for r in track]
    y = [math.radians(r[1] - lat0) / NM for r in track]
    x = [math.radians(r[2] - lon0) * math.cos(math.radians(lat0)) / NM for r in track]
    turn = lambda p, q: abs((p - q + math.pi) % (2 * math.pi) - math.pi)
    found, k = [], 0
    while t[0] + k * cfg.window_s / 2 < t[-1] - cfg.window_s / 2:
        lo = t[0] + k * cfg.window_s / 2
        ids = [i for i in range(len(t)) if lo <= t[i] < lo + cfg.window_s]
        k += 1
        if len(ids) < cfg.min_reports:
            continue
        keep = [ids[0]]
        for i in ids:
            if math.hypot(x[i] - x[keep[-1]], y[i] - y[keep[-1]]) >= cfg.min_move_nm:
                keep.append(i)
        legs, begin, sx, sy = [], 0, 0.0, 0.0
        for j in range(1, len(keep)):
            dx, dy = x[keep[j]] - x[keep[j - 1]], y[keep[j]] - y[keep[j - 1]]
            if (sx or sy) and turn(math.atan2(dy, dx), math.atan2(sy, sx)) > math.radians(cfg.turn_deg):
                legs.append((keep[begin], keep[j - 1], math.atan2(sy, sx)))
                begin, sx, sy = j - 1, 0.0, 0.0
            sx, sy = sx + dx, sy + dy
        if len(keep) < 3:
            continue
        legs.append((keep[begin], keep[-1], math.atan2(sy, sx)))
        size = lambda leg: math.hypot(x[leg[1]] - x[leg[0]], y[leg[1]] - y[leg[0]])
        legs = [leg for leg in legs if size(leg) >= cfg.min_leg_nm]
        if not legs:
            continue
        axis = max(legs, key=size)[2]
        best = []
        for some in (legs, [leg for leg in legs if min(turn(leg[2], axis), math.pi - turn(leg[2], axis)) <= math.radians(cfg.parallel_deg)]):
            for i in range(len(some)):
                j = i
                while j + 1 < len(some) and turn(some[j + 1][2], some[j][2]) >= math.radians(cfg.back_deg):
                    j += 1
                if j - i + 1 > len(best):
                    best = some[i : j + 1]
        if len(best) < cfg.min_legs:
            continue
        lens = [size(leg) for leg in best]
        mean = sum(lens) / len(lens)
        side = []
        for p, q in zip(best, best[1:]):
            dx = (x[q[0]] + x[q[1]] - x[p[0]] - x[p[1]]) / 2
            dy = (y[q[0]] + y[q[1]] - y[p[0]] - y[p[1]]) / 2
            side.append(abs(-dx * math.sin(p[2]) + dy * math.cos(p[2])))
        a, b = best[0][0], best[-1][1]
        path = sum(math.hypot(x[i + 1] - x[i], y[i + 1] - y[i]) for i in range(a, b))
        hours = (t[b] - t[a]) / 3600
        spread = math.sqrt(sum((v - mean) ** 2 for v in lens) / len(lens))
        if spread > cfg.length_spread * mean or sum(side) / len(side) < cfg.side_step * mean or hours <= 0 or path / hours > cfg.max_kn:
            continue
        if sum(track[leg[0]][3] for leg in best) / len(best) > cfg.benign_share:
            continue
        found.append((a, b, len(best), round(mean, 6), round(sum(side) / len(side), 6), round(path, 6)))
    out = []
    for s in sorted(found):
        if out and s[0] <= out[-1][1]:
            keep = s[2:] if s[2] > out[-1][2] else out[-1][2:]
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), *keep)
        else:
            out.append(s)
    return out


def lawnmower(n_lines, leg_nm, step_nm, every_s, kn, rng, noise=0.05):
    x = y = 0.0
    path = []
    for k in range(n_lines):
        way = 1 if k % 2 == 0 else -1
        for _ in range(int(leg_nm / (kn * every_s / 3600))):
            x += way * kn * every_s / 3600
            path.append((x, y))
        y += step_nm
    return [(24 + b / 60 + rng.gauss(0, noise / 60), 120 + a / 60 / math.cos(math.radians(24)) + rng.gauss(0, noise / 60)) for a, b in path]


def made_tracks():
    rng = random.Random(8)
    tracks = {"mower": lawnmower(9, 12, 1.5, 900, 5, rng), "fast": lawnmower(9, 30, 4, 900, 14, rng), "shuttle": lawnmower(9, 12, 0.0, 900, 5, rng, 0.01)}
    tracks["transit"] = [(20 + 0.02 * k, 118 + 0.02 * k) for k in range(200)]
    for k in range(12):  # random walks
        la, lo, out = 24.0, 120.0, []
        for _ in range(250):
            la, lo = la + rng.choice([-0.06, 0.06, 0.02]), lo + rng.gauss(0, 0.02)
            out.append((la, lo))
        tracks[f"walk{k}"] = out
    rows, sessions = [], {}
    event = 0
    for v, path in tracks.items():
        t, session = 1.7e9, 0
        for k, (la, lo) in enumerate(path):
            t += 900 if v in ("mower", "fast", "shuttle") else rng.choice([1200, 2400, 3600])
            if k and k % 170 == 0:
                t, session = t + 200_000, session + 1
            event += 1
            rows.append((v, event, t, la, lo, None, 70, rng.random() < 0.2))
            sessions.setdefault((v, session), []).append((t, la, lo, rows[-1][-1]))
    return rows, sessions


def test_survey_stretches(spark):
    cfg = S.SurveyConfig()
    rows, sessions = made_tracks()
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "track_id string, event_id long, t double, latitude double, longitude double, sog double, vessel_type int, benign boolean")
    got = {}
    for r in S.survey_stretches(df, cfg).orderBy("track_id", "session", "a").collect():
        got.setdefault((r.track_id, r.session), []).append((r.a - 1, r.b - 1, r.legs, round(r.mean_leg_nm, 6), round(r.spacing_nm, 6), round(r.path_nm, 6)))
    want = {k: found for k, track in sessions.items() if (found := plain_stretches(track, cfg))}
    assert set(got) == set(want)
    for k in want:
        assert len(got[k]) == len(want[k])
        for a, b in zip(got[k], want[k], strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-5), k
    names = {v for v, _ in got}
    assert "mower" in names and not names & {"fast", "shuttle", "transit"} and len(names) > 3
    events = S.survey_events(df, cfg).collect()
    assert len(events) == sum(map(len, want.values())) and all(78 <= e.severity <= 98 and e.t1 > e.t0 for e in events)


def test_survey_small(spark):
    schema = "track_id string, event_id long, t double, latitude double, longitude double, sog double, vessel_type int, benign boolean"
    assert S.survey_events(spark.createDataFrame([], schema), S.SurveyConfig()).count() == 0
    rows = [("a", k, 100.0 * k, None, 3.0, None, None, None) for k in range(30)] + [("b", k, 5.0, 2.0, 3.0, None, None, None) for k in range(30)]
    assert S.survey_events(spark.createDataFrame(rows, schema), S.SurveyConfig()).count() == 0
