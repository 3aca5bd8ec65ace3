"""Operators at sizes and skews that one task couldn't hold, by small bounds: quantile buckets, chains of overlaps, bursts, numbered lines, split images, histograms."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import bytes as B
from lacuna.operators import intervals as I
from lacuna.operators.ordered import cuts, number_rows, reached, running_before, with_buckets
from lacuna.plans import carve as C
from lacuna.plans import crossverify as X
from lacuna.plans import imaged
from lacuna.plans.streams import tiny_avi, tiny_jpeg
from lacuna.sources import lines as L
from lacuna.sources import manifest as M
from lacuna.sources.rawimage import ImageFile, input_size, read_image, write_parts
from lacuna.sources.reports import normal_path


def test_crowded_values_are_spread(spark):
    """99 % of the values lie in 1 % of the range."""
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.col("id") * 1000).otherwise(F.lit(5_000_000) + F.col("id") * 10).alias("x"))
    sizes = [r["count"] for r in with_buckets(df, "x", rows=500).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 35 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    ends = with_buckets(df, "x", rows=500).groupBy("_bucket").agg(F.min("x").alias("a"), F.max("x").alias("z")).orderBy("_bucket").collect()
    assert all(p.z < q.a for p, q in zip(ends, ends[1:], strict=False))
    got = number_rows(df, [], ["x"], "n", rows=500).orderBy("x").collect()
    assert [r.n for r in got] == list(range(1, 20_001))
    odd = spark.createDataFrame([(None,), (3,), (3,), (None,), (1,)], "x long")
    assert sorted(r.n for r in number_rows(odd, [], ["x"], "n", rows=1).collect()) == [1, 2, 3, 4, 5] and with_buckets(odd.limit(0), "x").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100])
def test_halving_finds_the_place(spark, n):
    splits = sorted(random.Random(n).sample(range(1000), n))
    got = spark.range(-1, 1001, 7).select("id", reached(splits, F.col("id")).alias("at")).collect()
    assert [r["at"] for r in got] == np.searchsorted(splits, [r.id for r in got], "right").tolist()


def plain_greedy(rows):
    out, until = [], None
    for a, z, i in sorted(rows):
        if until is None or a >= until:
            out.append(i)
            until = max(a if until is None else until, z)
    return out


@pytest.mark.parametrize(("chain_rows", "block_rows"), [(10, 7), (10, 100), (500, 64), (10**6, 10**5)])
def test_long_chains_equal_the_scan(spark, chain_rows, block_rows):
    """One key is a single chain of overlaps, one falls into many clusters, one has equal and empty spans; long clusters are followed by pointers."""
    r, rows = random.Random(block_rows), []
    for i in range(1500):
        a = 10 * i + r.randint(0, 9)
        rows.append(("chain", a, a + r.choice([15, 40, 200, 1000]), i))
    rows += [("gaps", 100 * i, 100 * i + r.choice([20, 150, 240]), 2000 + i) for i in range(400)]
    rows += [("odd", r.randint(0, 60), None, 3000 + i) for i in range(5)]
    rows += [(None, a, a + r.choice([0, 0, 3, 30, -2]), 4000 + i) for i, a in enumerate(r.choices(range(200), k=300))]
    df = spark.createDataFrame(rows, "k string, a long, z long, id long").repartition(6)
    got = I.greedy_nonoverlap(df, ["k"], "a", "z", ["z", "id"], rows=200, chain_rows=chain_rows, block_rows=block_rows)
    want = {i for k in ("chain", "gaps", None) for i in plain_greedy([(a, z, i) for key, a, z, i in rows if key == k and z is not None])}
    assert got.columns == df.columns and sorted(x.id for x in got.collect()) == sorted(want)


def test_blocks_of_a_long_key_see_the_rows_before(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.9 else r.choice("ab"), i, i * 10 + r.randint(0, 5), r.choice("xyz")) for i in range(3000)]
    df = spark.createDataFrame([*rows, (None, 1, 1, "x")], "k string, seq long, at long, size string").repartition(5)
    ask = lambda rows: {(x.k, x.seq): x.burst for x in I.burst_members(df, ["k"], ["seq"], "at", F.col("size"), window=300, least=3, step=60, memory=16, rows=rows).collect()}
    whole, cut = ask(10**6), ask(50)
    assert whole == cut and len(whole) == 3001 and 100 < sum(whole.values()) < 2900


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_lines_are_numbered_over_splits(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(L, "READ", 5)
    files = {"a.txt": b"one\ntwo\r\n\n\nlast without end", "b.txt": b"", "c.txt": b"\n", "d.txt": "é日本\n".encode() * 9, "e.txt": b"x" * 50 + b"\r\n" + b"\xff\n", "f.txt": b"\r\r\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for row in L.numbered_lines(spark, str(tmp_path), split).collect():
        got.setdefault(row.line_file.rsplit("/", 1)[1], []).append((row.line_no, row.line))
    for name, data in files.items():
        lines = data.split(b"\n")
        lines = lines if lines[-1] else lines[:-1]
        assert sorted(got.get(name, [])) == [(i + 1, x.removesuffix(b"\r").decode("utf-8", "replace")) for i, x in enumerate(lines)], name


def test_images_in_parts(spark, tmp_path):
    r = random.Random(2)
    whole, pieces = bytearray(10_000), []
    for at, n in ((0, 10), (700, 4000), (4700, 1), (5000, 3000), (9000, 1000)):
        data = r.randbytes(n)
        whole[at : at + n] = data
        pieces.append((at, data))
    path = write_parts(spark.createDataFrame([*pieces, (20, b"")], "place long, data binary"), 10_000, f"file://{tmp_path}/image", part=512)
    assert input_size(path) == 10_000 and not (tmp_path / "image" / "0000000001.part").stat().st_size > 512 and not (tmp_path / "image" / "0000000000.part.tmp").exists()
    with ImageFile(path) as f:
        for at, n in ((0, 10_000), (500, 30), (511, 2), (9_990, 100), (10_000, 5), (8200, 600)):
            f.seek(at)
            assert f.read(n) == bytes(whole[at : at + n])
    rows = read_image(spark, path, tile=1000, partition_bytes=3000, overlap=9).orderBy("offset").collect()
    assert b"".join(bytes(x.data[: x.length]) for x in rows) == bytes(whole)


def test_zeros_take_no_disk_in_images_and_copies(spark, tmp_path):
    noise = random.Random(4).randbytes(50_000)
    whole = b"x" * 300_000 + bytes(1_700_000) + noise + bytes(900_000) + b"y" * 50_000 + b"\0"
    pieces = [(0, b"x" * 300_000), (2_000_000, noise), (2_950_000, b"y" * 50_000)]
    path = write_parts(spark.createDataFrame(pieces, "place long, data binary"), len(whole), f"file://{tmp_path}/image", part=500_000)
    assert sum(f.stat().st_size for f in (tmp_path / "image").iterdir()) < 60_000
    with ImageFile(path) as f:
        for at, n in ((0, len(whole)), (299_990, 30), (1_999_000, 60_000), (499_999, 2), (len(whole) - 3, 9)):
            f.seek(at)
            assert f.read(n) == whole[at : at + n]
    told = spark.createDataFrame([("a/all", 0, len(whole)), ("a/end", 100, len(whole) - 1), ("a/zeros", 400_000, 409_000)], "path string, source_offset long, source_end long")
    assert {r.path: (r.bytes, r.sha256) for r in C.extract(told, path, f"{tmp_path}/out").collect()}["a/all"] == (len(whole), hashlib.sha256(whole).hexdigest())
    for r in told.collect():
        copy = tmp_path / "out" / r.path
        assert copy.read_bytes() == whole[r.source_offset : r.source_end] and copy.stat().st_blocks * 512 < 450_000


def test_histograms_merge(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), r.randbytes(r.randint(0, 50)) if r.random() < 0.9 else None) for _ in range(500)]
    rows += [("empty", b""), ("nothing", None)]
    got = {x.k: (x.n_bytes, round(x.entropy, 9)) for x in B.entropy_by(spark.createDataFrame(rows, "k string, data binary").repartition(7), ["k"], F.col("data")).collect()}
    joined = {k: b"".join(d or b"" for q, d in rows if q == k) for k, _ in rows}
    assert got == {k: (len(d), round(B.entropy_of(d), 9)) for k, d in joined.items()}
    assert B.entropy_by(spark.createDataFrame([], "k string, data binary"), ["k"], F.col("data")).count() == 0


def test_small_splits_make_no_small_tasks(spark, tmp_path):
    """10,000 splits of 1000 bytes, in two files, are one task's work; splits of more than a task's bytes are a task each."""
    import json

    reader = lambda size: L.LinesReader({"files": json.dumps([["a", 9_000_000], ["b", 0], ["c", 999_999]]), "split_bytes": str(size)})
    pieces = reader(1000).partitions()
    assert len(pieces) == 1 and pieces[0].splits[0] == ("a", 0, 0, 1000) and pieces[0].splits[-1] == ("c", 999, 999_000, 999_999) and len(pieces[0].splits) == 10_000
    assert [len(p.splits) for p in reader(100).partitions()] == [10_000] * 10
    assert [len(p.splits) for p in L.LinesReader({"files": json.dumps([["a", 100 << 20]]), "split_bytes": str(40 << 20)}).partitions()] == [1, 1, 1]
    (tmp_path / "log").write_bytes(b"".join(b"%d\n" % i for i in range(20_000)))
    found = L.numbered_lines(spark, str(tmp_path / "log"), 100)
    assert found.rdd.getNumPartitions() <= 8 and found.where("line_no <> cast(line AS bigint) + 1").count() == 0 and found.count() == 20_000


def test_listing_is_made_by_tasks_per_folder(spark, tmp_path):
    """400 small files in three folders: hidden names aside, each stands there once, in a few tasks and not one for every four files."""
    files = {f"{folder}/f{i:03d}.{ext}": bytes(i % 7) for folder, ext in (("a", "jpg"), ("a/b c", "JPG"), ("d", "avi")) for i in range(134)}
    for name, data in (files | {"top.jpg": b"xy", ".hidden": b"x", "_temporary/0/x.jpg": b"x", "_p=1/y.jpg": b"abc", "d/x._COPYING_": b"x"}).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {f"file:{tmp_path}/{name}": len(data) for name, data in (files | {"top.jpg": b"xy", "_p=1/y.jpg": b"abc"}).items()}
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        found = M.listing(spark, path)
        assert {r.path: r.size for r in found.collect()} == want and found.count() == len(want) and found.rdd.getNumPartitions() <= 12
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")
    assert {tuple(r) for r in plain.collect()} == {x for x in want.items() if x[1]}  # which passes over empty files
    assert M.listing(spark, str(tmp_path), ("jpg",)).count() == 134 * 2 + 2 and M.listing(spark, f"{tmp_path}/d/*").count() == sum(i % 7 > 0 for i in range(134))
    assert [(r.name, r.size) for r in M.listing(spark, f"{tmp_path}/top.jpg").collect()] == [("top.jpg", 2)]
    (tmp_path / "none").mkdir()
    assert M.listing(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        M.listing(spark, f"{tmp_path}/nowhere")


def test_hashing_and_copying_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    """40 narrow rows that have 40 kB to read go to several tasks, whatever the rows themselves weigh."""
    data = random.Random(4).randbytes(40_000)
    (tmp_path / "image").write_bytes(data)
    monkeypatch.setattr(C, "TASK_BYTES", 4000)
    rows = spark.range(40).select(F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 999).alias("end"))
    hashed = C.with_hashes(rows.repartition("path"), f"{tmp_path}/image", C.Settings()).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in hashed}) >= 4 and {(r.path, r.sha256) for r in hashed} == {(f"p/{i}", hashlib.sha256(data[1000 * i : 1000 * i + 999]).hexdigest()) for i in range(40)}
    told = rows.select("path", F.col("start").alias("source_offset"), F.col("end").alias("source_end")).repartition("path")
    done = C.extract(told, f"{tmp_path}/image", f"{tmp_path}/out").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in done}) >= 4 and all((tmp_path / "out" / r.path).read_bytes() == data[1000 * int(r.path[2:]) :][:999] for r in done)


@pytest.mark.parametrize("sent", [0, 200_000])
def test_pieces_are_laid_in_order_by_either_join(spark, monkeypatch, sent):
    monkeypatch.setattr(imaged, "SENT_ROWS", sent)
    pieces = [(i, bytes([i]) * (i % 5)) for i in range(1, 60)]
    path = imaged.lay_in_order(spark, spark.createDataFrame(pieces[::-1], "nr long, data binary"), "nr")
    with ImageFile(path) as f:
        assert f.read(1000) == b"".join(x for _, x in pieces)


def test_films_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    """24 films in one folder, which one task lists, are read by several."""
    for i in range(24):
        (tmp_path / f"{i}.avi").write_bytes(tiny_avi([tiny_jpeg(2, 2, body=b"x" * (200 + i))]))
    monkeypatch.setattr(X, "TASK_BYTES", 1000)
    for files in (M.listing(spark, str(tmp_path), ("avi",)), M.listing(spark, str(tmp_path)).drop("size")):
        got = X.frames_of_files(files).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.video for r in got) == sorted(f"{i}.avi" for i in range(24)) and (len({r.task for r in got}) >= 4 or "size" not in files.columns)


def test_one_bucket_gives_what_many_give(spark):
    """Rows that are one bucket are put in order by one window; null keys and orders, and all kinds of values, are as with buckets. Runs count their rows once."""
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randint(-9, 9)])) for i in range(300)]
    for more in ([], [("a", None, 3)]):
        df = spark.createDataFrame([*rows, *more], "k string, at long, v long").repartition(3)
        ask = lambda n: sorted(map(str, running_before(df, ["k"], ["at"], {"s": (F.col("v"), "sum"), "m": (F.col("v"), "max"), "l": (F.col("v"), "last")}, n).collect()))
        assert ask(10**6) == ask(20) and cuts(df, "at", 10**6) == ([] if more else None) and len(cuts(df, "at", 20)) >= 10
        runs = lambda n: sorted(map(str, I.gap_regions(df, ["k"], "at", None, 3, ties=["v"], rows=n).collect()))
        assert runs(10**6) == runs(20)


def test_plain_paths_stay_and_odd_ones_are_put_right(spark):
    paths = ["a/b.jpg", "/a/b", "a//b", "./a", "a/./b", "a/../b", "..", "../a", "a/b/", "/", "//", "", ".", "a/.b/c..d", "...", "a/...", "é/日"]
    want = ["a/b.jpg", "/a/b", "a/b", "a", "a/b", "b", "..", "../a", "a/b", "/", "/", "", "", "a/.b/c..d", "...", "a/...", "é/日"]
    got = spark.createDataFrame([(i, p) for i, p in enumerate([*paths, None])], "i int, p string").select("i", normal_path(F.col("p")).alias("n")).orderBy("i").collect()
    assert [x.n for x in got] == [*want, None]
