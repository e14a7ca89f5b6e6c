import random

import pytest
from pyspark.sql import functions as F

from trackweave.options import TrackOptions
from trackweave.plans import streams
from trackweave.schema import LOG_RECORD
from trackweave.streaming import track as T


def simulate(events, timeout, limit, bucket, mark):
    """Event by event, in order of time; what the watermark `mark` has not passed stays: (done, left)."""
    end = lambda t: (t // bucket + 1) * bucket
    done, open_, left = [], {}, {}
    for at, group, seq, tag in sorted(events):
        if end(at) > mark:
            left.setdefault(group, []).append(seq)
            continue
        for g in [g for g, (first, _) in open_.items() if first + timeout <= at]:
            done.append((g, "timeout", open_.pop(g)[1]))
        first, held = open_.setdefault(group, (at, []))
        held.append(seq)
        if tag == "End":
            done.append((group, "end", open_.pop(group)[1]))
        while len(open_) > limit:
            oldest = next(iter(open_))
            done.append((oldest, "limit", open_.pop(oldest)[1]))
    for g in [g for g, (first, _) in open_.items() if end(first + timeout) <= mark]:
        done.append((g, "timeout", open_.pop(g)[1]))
    for g, (_, held) in open_.items():
        left.setdefault(g, []).extend(held)
    return sorted((g, r, sorted(x)) for g, r, x in done), sorted((g, sorted(x)) for g, x in left.items())


def events(seed, n=140):
    r, out = random.Random(seed), []
    for group in range(n):
        first = group * 300 + r.randint(0, 200)
        times = sorted(first + r.choice([0, r.randint(0, 900), r.randint(0, 6000)]) for _ in range(r.randint(1, 5)))
        out += [(t, group, i, "VCL_Log") for i, t in enumerate(times)]
        if r.random() < 0.6:
            out.append((times[-1] + r.randint(1, 300), group, 9, "End"))
    return out


def write(spark, path, rows, files):
    """In order of time, but for rows that are mixed within a file."""
    rows = sorted(rows)
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        log = spark.createDataFrame([(g, g, None, "req", "c", 0, seq, tag, str(at), None) for at, g, seq, tag in part], LOG_RECORD)
        log = log.withColumn("ts", F.timestamp_millis(F.col("payload").cast("long"))).repartition(3, "rec_seq").coalesce(1)
        log.write.mode("append").parquet(path)
        # a stream takes files by their dates
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((s.getModificationTime(), s.getPath().toString()) for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))
    for i, (_, name) in enumerate(parts):
        system.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name), 1_000_000 + 1000 * i, -1)


@pytest.mark.parametrize(("seed", "files", "limit", "timeout"), [(1, 1, 4, 3.0), (1, 4, 4, 3.0), (2, 3, 2, 5.0), (3, 3, 1000, 2.0)])
def test_against_a_simulation(spark, tmp_path, seed, files, limit, timeout):
    """One shard is exact, and the cut into batches does not matter."""
    path, rows = str(tmp_path / "log"), events(seed)
    write(spark, path, rows, files)
    options = TrackOptions(tx_limit=limit, tx_timeout=timeout)
    done, checkpoint, _ = streams.run(spark, path, lambda log: T.track_requests(log, options, shards=1, bucket=0.5, delay="2 seconds"))
    mark = max(at for at, *_ in rows) - 2000
    want, left = simulate(rows, int(timeout * 1000), limit, 500, mark)
    assert sorted((r.group_vxid, r.complete_reason, sorted(x.rec_seq for x in r.records)) for r in done.collect()) == want
    assert sorted((r.group_vxid, sorted(x.rec_seq for x in r.records)) for r in T.drain_tracked(spark, checkpoint).collect()) == left
    assert {r for _, r, _ in want} >= ({"end", "timeout"} if limit == 1000 else {"end", "limit"})


def test_rows_on_their_way_are_bounded(spark, tmp_path):
    """Rows go to their buckets seven at a time, and the result is the same."""
    path, rows = str(tmp_path / "log"), events(5, 40)
    write(spark, path, rows, 2)
    options = TrackOptions(tx_limit=3, tx_timeout=2)
    done, _, _ = streams.run(spark, path, lambda log: T.track_requests(log, options, shards=1, bucket=1, delay="1 second", held=7))
    want, _ = simulate(rows, 2000, 3, 1000, max(at for at, *_ in rows) - 1000)
    assert sorted((r.group_vxid, r.complete_reason, sorted(x.rec_seq for x in r.records)) for r in done.collect()) == want


def test_buckets_of_a_batch_are_read_once():
    """A batch that passes a thousand buckets reads and writes the list of those that wait once, not once a bucket."""
    from types import SimpleNamespace

    class State(dict):
        reads = writes = 0

        def exists(self):
            return True

        def get(self):
            self.reads += 1
            return (list(range(1000, 1_001_000, 1000)),)

        def update(self, value):
            self.writes += 1
            self.left = value[0]

        def getValue(self, key):
            return ([(key[0] * 1000, 1)],)

        def removeKey(self, key):
            self[key] = None

    class Kept(T.InTimeOrder):
        def take(self, rows, until):
            yield from rows

    p = Kept(1000, "at_ms long, n long", held=7)
    states = {"waiting": State(), "pending": State()}
    p.init(SimpleNamespace(getMapState=lambda name, *_: states[name], getValueState=lambda name, *_: states[name]))
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 900_500)
    got = [r for end in range(1000, 901_000, 1000) for r in p.handleExpiredTimer((0,), times, SimpleNamespace(getExpiryTimeInMs=lambda end=end: end))]
    assert got == [(i * 1000, 1) for i in range(900)] and len(states["waiting"]) == 900
    assert (states["pending"].reads, states["pending"].writes) == (1, 1) and states["pending"].left == list(range(901_000, 1_001_000, 1000))
