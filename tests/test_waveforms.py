"""Association of findings against a plain scan over all observations."""

import random
import time

from pyspark.sql import functions as F

from bandwatch.operators import waveforms

SCHEMA = (
    "session_id bigint, seq bigint, bandwidth_hz int, spreading_factor int, center_hz double, delimiter_sample double, subband int, "
    "sample_rate int, up_match double, down_match double"
)


def associated_by_hand(rows):
    """Findings in order of arrival; every observation of the class is looked at."""
    known = {}
    for session, _, bandwidth, sf, c, t, band, rate, up, down in sorted(rows, key=lambda r: r[1]):
        own = known.setdefault((session, bandwidth, sf), [])
        reach, tolerance = 2.0 * bandwidth / 2**sf, 2.0 * rate / bandwidth
        fits = [
            o for o in own
            if band not in o["bands"] and max(*o["c"], c) - min(*o["c"], c) <= reach and max(*o["t"], t) - min(*o["t"], t) <= tolerance
        ]
        if len(fits) != 1:
            own.append({"bands": {band}, "c": [c, c], "t": [t, t], "best": (c, t, up, down), "score": min(up, down), "n": 1, "split": len(fits) > 1})
            continue
        o = fits[0]
        o["bands"].add(band)
        o["c"], o["t"], o["n"] = [min(*o["c"], c), max(*o["c"], c)], [min(*o["t"], t), max(*o["t"], t)], o["n"] + 1
        if min(up, down) > o["score"]:
            o["best"], o["score"] = (c, t, up, down), min(up, down)
    return sorted((*key, *o["best"], len(o["bands"]), o["n"], o["split"]) for key, own in known.items() for o in own)


def test_association_equals_a_plain_scan(spark):
    """Never a pause of a tolerance, late arrivals, several centers at once, the edges of both tolerances."""
    rng, rows, t = random.Random(2), [], 0.0
    for i in range(1500):
        bandwidth, sf = rng.choice([(125_000, 7), (125_000, 7), (250_000, 8)])
        reach, tolerance = 2.0 * bandwidth / 2**sf, 2.0 * 1_000_000 / bandwidth
        t += rng.choice([0.0, tolerance / 4, tolerance])
        center = 9e8 + rng.choice([0, 1, 2, 40, 41, 90]) * reach / 2 + rng.choice([0.0, 1.0])
        late = rng.choice([0, 0, 0, -tolerance, tolerance / 2])
        rows.append((1 + i % 2, i, bandwidth, sf, center, t + late, rng.randrange(4), 1_000_000, rng.random(), rng.random()))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in waveforms.associate_findings(df, 500).collect())
    want = associated_by_hand(rows)
    assert got == want and sum(w[-2] > 1 for w in want) > 100 and any(w[-1] for w in want)


def test_association_takes_linear_time_on_one_long_part():
    def seconds(n):
        walker, begin = waveforms._Associator((1, 125_000, 7, 0, 0, 0)), time.perf_counter()
        row = type("Row", (), {})
        for i in range(n):
            r = row()
            r.center_hz, r.delimiter_sample, r.subband, r.sample_rate, r.bandwidth_hz, r.up_match, r.down_match = 9e8, i * 10.0, i % 4, 10**6, 125_000, 1.0, 1.0
            walker.row(r)
        assert len(walker.close()) >= n // 8
        return time.perf_counter() - begin

    assert seconds(40_000) < 20 * max(0.2, seconds(4_000))


def test_association_of_no_findings(spark):
    assert waveforms.associate_findings(spark.createDataFrame([], SCHEMA).where(F.lit(True))).count() == 0
