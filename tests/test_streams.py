"""Tables in buckets, and stateful streams over several micro-batches and restarts."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators.documents import file_changes
from tarn.sources.buckets import Buckets, Conflict
from tarn.sources.store import Store
from tarn.streaming import watcher

# buckets


SCHEMA = "id long, n long, v string, status string"


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_conditional_upsert(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), SCHEMA, ["id"], 16)
    assert table.read().count() == 0
    rows = [(i, 1, f"v{i}", "open" if i % 3 else "closed") for i in range(300)]
    table.upsert(spark.createDataFrame(rows, SCHEMA), ["id"])
    new = [(i, 10, f"w{i}", "new") for i in range(290, 310)] + [(5, 7, "a", "new"), (5, 8, "b", "new"), (None, 1, "x", "y"), (None, 1, "x", "y")]
    table.upsert(spark.createDataFrame(new, SCHEMA), ["id"], {"n": F.col("old.n") + F.col("new.n"), "v": F.col("new.v")}, F.col("old.status") == "open")
    want = {i: (1, f"v{i}", s) for i, _, _, s in rows}
    for i, n, v, s in [*[x for x in new if x[0] not in (None, 5)], (5, 8, "b", "new")]:
        if i not in want:
            want[i] = (n, v, s)
        elif want[i][2] == "open":
            want[i] = (want[i][0] + n, v, want[i][2])
    got = table.read().collect()
    assert {r.id: (r.n, r.v, r.status) for r in got if r.id is not None} == want and len(got) == len(want) + 2
    # nothing, and all columns
    one = spark.createDataFrame([(1, 99, "z", "new")], SCHEMA)
    table.upsert(one, ["id"])
    assert table.read().filter("id = 1").first().n == 1
    table.upsert(one, ["id"], {})
    assert tuple(table.read().filter("id = 1").first()) == (1, 99, "z", "new")
    assert table.read(0).count() == 300  # the first version as it was
    table.forget()
    assert table.versions() == [3] and table.read().count() == len(want) + 2
    assert Buckets(spark, str(tmp_path / "t"), "", []).n == 16


def test_writes_grow_with_the_change(spark, tmp_path):
    written = {}
    for n in (2_000, 20_000):
        table = Buckets(spark, str(tmp_path / f"t{n}"), SCHEMA, ["id"], n // 20)
        table.upsert(spark.range(n).selectExpr("id", "1 as n", "sha2(cast(id as string), 512) as v", "'s' as status"), ["id"])
        before = size(tmp_path / f"t{n}")
        table.upsert(spark.createDataFrame([(i, 5, "w", "s") for i in range(4)], SCHEMA), ["id"], {"n": F.col("old.n") + F.col("new.n")})
        written[n] = size(tmp_path / f"t{n}") - before
        assert table.read().agg(F.sum("n")).first()[0] == n + 20
    assert written[20_000] < 1.5 * written[2_000] and written[20_000] < before / 50


def test_writers_at_once(spark, tmp_path):
    one, two = (Buckets(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4) for _ in range(2))
    rows = spark.createDataFrame([(1, 1, "a", "s")], SCHEMA)
    stale = two.manifest
    one.upsert(rows, ["id"])
    two.manifest = lambda version=None: None if version is None else stale(version)  # it started before the other was done
    with pytest.raises(Conflict):
        two.upsert(rows, ["id"])
    assert one.read().count() == 1


def test_replaced_groups(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    table = store.buckets("parts", "id string, k int", ["id"], 8)
    assert not store.exists("parts")
    frame = lambda rows: spark.createDataFrame(rows, "id string, k int")
    table.replace(frame([("a", 0), ("a", 1), ("b", 0), ("c", 0)]))
    table.replace(frame([("a", 5)]), frame([("c", 0), ("d", 0)]))
    assert sorted(map(tuple, store.read("parts").collect())) == [("a", 5), ("b", 0)] and store.exists("parts")


# streams


T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def walked(rng):
    """Walks every 10 seconds over files that are written, rewritten, removed and come back: [{path: (modified, length)}]."""
    files, walks = {}, []
    for k in range(14):
        now = 10 * k
        for p in "abcdef":
            if rng.random() < 0.25:
                files[p] = (now - rng.choice([0.5, 1, 1.5, 4]), rng.randrange(100))
            elif rng.random() < 0.2:
                files.pop(p, None)
        walks.append(dict(files) | {"always": (0, 1)})
    return walks


def expected(walks):
    """By going through the walks one after the other."""
    out, state = [], {}
    for k, walk in enumerate(walks):
        now = 10 * k
        for p, s in state.items():
            if not s["told"] and s["modified"] + 2 <= (now if walk.get(p) == s["version"] else walk[p][0] if p in walk else now):
                out.append((p, "changed" if s["known"] else "fresh", s["modified"], s["modified"] + 2))
                s["told"] = s["known"] = True
            if p not in walk and not s["missing"] and now > s["seen"] + 15:
                out.append((p, "missing", s["modified"], s["seen"] + 15))
                s["missing"] = True
        for p, version in walk.items():
            s = state.setdefault(p, {"version": None, "known": False, "missing": False, "told": True, "seen": now, "modified": None})
            if not s["missing"] and now - s["seen"] > 15:
                out.append((p, "missing", s["modified"], s["seen"] + 15))
                s["missing"] = True
            if s["missing"]:
                out.append((p, "back", version[0], now))
                s["missing"] = False
            if version != s["version"]:
                s |= {"version": version, "modified": version[0], "told": version[0] + 2 <= now}
                if s["told"]:
                    out.append((p, "changed" if s["known"] else "fresh", version[0], now))
                    s["known"] = True
            s["seen"] = now
    return sorted(out)


def follow(spark, folder, checkpoint, out, per_trigger, build, schema):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(str(folder))
    writer = build(source).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(checkpoint))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


SIGHTINGS = "path string, modified timestamp, length long, seen timestamp"


def test_watched_folder(spark, tmp_path):
    walks = walked(random.Random(8))
    want = expected(walks)
    assert {c for _, c, _, _ in want} == {"fresh", "changed", "missing", "back"}
    build = lambda source: watcher.file_changes(source, 15_000)
    for name, per_trigger, stops in (("restarted", 2, (6, 14)), ("at once", 100, (14,))):
        base = tmp_path / name
        (base / "in").mkdir(parents=True)
        done = 0
        for stop in stops:  # the stream ends and begins again between the stops
            for k in range(done, stop):
                rows = [{"path": p, "modified": at(m).isoformat(), "length": n, "seen": at(10 * k).isoformat()} for p, (m, n) in walks[k].items()]
                (base / "in" / f"{k:03d}.json").write_text("\n".join(map(json.dumps, rows)))
                os.utime(base / "in" / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
            done = stop
            follow(spark, base / "in", base / "checkpoint", base / "out", per_trigger, build, SIGHTINGS)
        found = spark.read.schema(watcher.CHANGES).json(str(base / "out")).collect()
        got = sorted((r.path, r.change, (r.modified - T0).total_seconds(), (r.at - T0).total_seconds()) for r in found)
        assert got == want, name
    # what is missing at the end is what the batch function finds from one walk to the last
    known = {p for w in walks for p in w}
    batch = file_changes(
        spark.createDataFrame([(p,) for p in known], "path string"),
        spark.createDataFrame([(p, at(m)) for p, (m, _) in walks[-1].items()], "path string, mtime timestamp"), F.lit(at(1000)),
    )
    last = {}
    for p, c, _, t in sorted(want, key=lambda x: x[3]):
        if c in ("missing", "back"):
            last[p] = c
    gone = {r.path for r in batch.filter("change = 'missing'").collect()}
    assert {p for p, c in last.items() if c == "missing"} == {p for p in gone if max(k for k, w in enumerate(walks) if p in w) < len(walks) - 2}


def test_checks_run_out(spark, tmp_path):
    day = 24 * 3600
    checks = [(0, {1: 0, 2: 0}), (20, {2: 20}), (40, {3: 40}), (55, {1: 55}), (90, {9: 90})]
    (tmp_path / "in").mkdir()
    for n, (_, rows) in enumerate(checks):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "checked_at": at(d * day).isoformat()}) for i, d in rows.items()))
        follow(spark, tmp_path / "in", tmp_path / "checkpoint", tmp_path / "out", 1, watcher.due_again, "id long, checked_at timestamp")
    found = spark.read.schema("id long, due_at timestamp").json(str(tmp_path / "out")).collect()
    # 2 was checked again before it ran out, 1 after; 9 isn't due by the end
    assert sorted((r.id, (r.due_at - T0).total_seconds() / day) for r in found) == [(1, 30), (1, 85), (2, 50), (3, 70)]
