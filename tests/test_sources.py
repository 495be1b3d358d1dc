from __future__ import annotations

import gzip
import hashlib
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.operators import numeric
from corpusmill.sources import files, jsonl, provenance, tensors
from corpusmill.streaming import batches


def test_stage_contract(spark, tmp_path):
    lines = ['\ufeff{"text":"first words","metadata":{"n":[1]}}', "  ", '{"text":"second","metadata":"plain"}', '{"note":1}', '{"text":"cut', '{"text":null}', "\t", '{"text":"\\u3000"}', "17"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, bad = jsonl.read_stage(spark, str(tmp_path / "in.jsonl"), "cpt")
    assert sorted((r.line, r.text) for r in good.collect()) == [(1, "first words"), (3, "second")]
    assert sorted((r.line, r.error) for r in bad.collect()) == [(4, "text_missing"), (5, "invalid_json"), (6, "text_missing"), (8, "text_missing"), (9, "text_missing")]
    with pytest.raises(ValueError, match="in.jsonl:"):
        jsonl.require_valid(good, bad)
    assert jsonl.require_valid(good, bad.limit(0)).count() == 2
    with pytest.raises(ValueError, match="no usable"):
        jsonl.require_valid(good.limit(0), bad.limit(0))


def test_messages_contract(spark, tmp_path):
    turns = [{"role": "system", "content": "Be brief."}, {"role": "user", "content": "Two plus two?"}, {"role": "assistant", "content": "Four."}]
    lines = [json.dumps({"messages": turns, "extra": [None]}), '{"messages":[]}', '{"messages":{"role":"user"}}', '{"turns":[]}']
    (tmp_path / "chat.jsonl").write_text("\n".join(lines), encoding="utf-8")
    good, bad = jsonl.read_stage(spark, str(tmp_path), "sft")
    assert [[tuple(m) for m in r.messages] for r in good.collect()] == [[(t["role"], t["content"]) for t in turns]]
    assert bad.count() == 3
    with pytest.raises(ValueError, match="unknown stage"):
        jsonl.read_stage(spark, str(tmp_path), "rl")


def test_lines_and_sinks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\n\n \x0cc\n", encoding="utf-8")
    assert sorted(r.value.strip() for r in jsonl.strings_of_lines(spark, str(tmp_path / "t.txt")).collect()) == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, "é", None), (2, "x", "y")], "id int, t string, n string")
    jsonl.write(rows, str(tmp_path / "out"), files=1)
    (part,) = (tmp_path / "out").glob("part-*")
    assert [json.loads(x) for x in part.read_text(encoding="utf-8").splitlines()] == [{"id": 1, "t": "é", "n": None}, {"id": 2, "t": "x", "n": "y"}]
    jsonl.write_buckets(rows, str(tmp_path / "buckets"), "id")
    assert {p.name for p in (tmp_path / "buckets").iterdir() if p.is_dir()} == {"id=1", "id=2"}


def test_inventory_and_checksums(spark, tmp_path):
    root = tmp_path / "tree"
    contents = {"readme.txt": b"one line", "deep/er/numbers.bin": bytes(range(256)), "deep/empty": b""}
    for name, data in (contents | {".cache/left/over.tmp": b"?"}).items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    want = sorted((name, len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items())
    assert sorted(tuple(r) for r in files.inventory(spark, str(root), limit=100).collect()) == want  # the larger one in blocks
    got = files.write_verification(spark, str(root), about="a tree")
    assert sorted(tuple(r) for r in got.collect()) == want
    told = {r.path: r.sha256 for r in files.read_checksums(spark, str(root / "VERIFIED.sha256")).collect()}
    assert told.keys() == {*contents, "snapshot_manifest.json"} and told["deep/empty"] == hashlib.sha256(b"").hexdigest()
    assert json.loads((root / "snapshot_manifest.json").read_text())["about"] == "a tree"
    (tmp_path / "manifest.json").write_text(json.dumps({"files": {"a": {"sha256": "x", "records": 1, "bytes": 2}, "b": {"sha256": None}}}))
    assert sorted(tuple(r) for r in files.read_manifest(spark, str(tmp_path / "manifest.json")).collect()) == [("a", "x", 1, 2), ("b", None, None, None)]
    assert files.write_marker(tmp_path, True).name == "PASSED" and files.write_marker(tmp_path, False).name == "FAILED" and not (tmp_path / "PASSED").exists()
    assert files.write_marker(f"file://{tmp_path}", True, spark).endswith("/PASSED") and (tmp_path / "PASSED").exists() and not (tmp_path / "FAILED").exists()


@pytest.fixture
def settings(spark):
    """Sets what a test changes in the session back."""
    before = dict(spark.conf.getAll)
    yield spark.conf
    for key, value in spark.conf.getAll.items():
        if key not in before:
            spark.conf.unset(key)
        elif before[key] != value:
            spark.conf.set(key, before[key])


#: What lines lose or could: a mark at the head, last line feeds, carriage returns, line feeds alone, names that a URI encodes.
ODD = {
    "plain.bin": random.Random(1).randbytes(300_000), "marked.bin": files.MARK + b"a\r\nb\r" * 9000, "ended.bin": files.MARK * 2 + b"x\n" * 9000, "feeds.bin": b"\n" * 9000, "one line.bin": b"y" * 90_000,
    "dé+p a%20b/[c] {d}.bin": random.Random(2).randbytes(50_000) + b"\n", "short.bin": b"\n", "empty.bin": b"", "coded.gz": gzip.compress(random.Random(3).randbytes(50_000)),
}


@pytest.mark.parametrize("root", ["{}", "viewfs://odd/in"])
def test_inventory_of_odd_files_in_any_store(spark, settings, tmp_path, root):
    """Also where only Spark reads, from files that a scan would split."""
    settings.set("fs.viewfs.mounttable.odd.link./in", f"file://{tmp_path}")
    settings.set("spark.sql.files.maxPartitionBytes", "4096")
    for name, data in (ODD | {".cache/x": b"z" * 5000}).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.inventory(spark, root.format(tmp_path), limit=1000).collect()
    assert sorted(tuple(r) for r in got) == sorted((name, len(data), hashlib.sha256(data).hexdigest()) for name, data in ODD.items())


@pytest.mark.parametrize("root", ["{}", "viewfs://held/in"])
def test_inventory_holds_no_file_whole(spark, settings, tmp_path, root):
    """Spark refuses to read a file of more than 10 MB whole here."""
    settings.set("fs.viewfs.mounttable.held.link./in", f"file://{tmp_path}")
    settings.set("spark.sql.sources.binaryFile.maxLength", str(10 << 20))
    data = random.Random(4).randbytes(12 << 20)
    (tmp_path / "t.parquet").write_bytes(data)
    assert [tuple(r) for r in files.inventory(spark, root.format(tmp_path), pattern="*.parquet").collect()] == [("t.parquet", len(data), hashlib.sha256(data).hexdigest())]


def test_lines_that_miss_bytes_give_no_hash():
    batch = pa.RecordBatch.from_pydict({"uri": ["f"] * 2, "length": [9] * 2, "line": [b"ab", b"c"]})
    with pytest.raises(ValueError, match="4 of 9 bytes"):
        list(files.line_hashes(iter([batch])))


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Longer than any array can be; sparse, so it takes no room."""
    with open(tmp_path / "long.bin", "wb") as out:
        out.seek((3 << 30) - 1)
        out.write(b"x")
    digest = hashlib.sha256()
    for _ in range(3 * 1024 - 1):
        digest.update(bytes(1 << 20))
    digest.update(bytes((1 << 20) - 1) + b"x")
    (row,) = files.inventory(spark, str(tmp_path)).collect()
    assert tuple(row) == ("long.bin", 3 << 30, digest.hexdigest())


def test_tensor_files(spark, tmp_path):
    data = struct.pack("<3f", 1.0, -2.0, 0.0) + struct.pack("<2H", 0x3F80, 0xC000)
    header = json.dumps({"__metadata__": {}, "a": {"dtype": "F32", "shape": [3], "data_offsets": [0, 12]}, "b": {"dtype": "BF16", "shape": [1, 2], "data_offsets": [12, 16]}}).encode()
    (tmp_path / "m.tensors").write_bytes(len(header).to_bytes(8, "little") + header + data)
    got = {r.name: (r.shape, r["values"]) for r in files.read_tensors(spark, str(tmp_path / "m.tensors")).collect()}
    assert got == {"a": ([3], [1.0, -2.0, 0.0]), "b": ([1, 2], [1.0, -2.0])}


def test_a_tensor_of_more_than_two_gigabytes_is_read_in_slices(spark, tmp_path):
    """Sparse, so it takes no room: F16 zeros, with a few values far apart, and other tensors beside it."""
    n = (2200 << 20) // 2
    small = np.array([1.0, -2.0, np.nan, np.inf, 0.0], "<f8")
    header = {"big": {"dtype": "F16", "shape": [2, n // 2], "data_offsets": [0, 2 * n]}, "small": {"dtype": "F64", "shape": [5], "data_offsets": [2 * n, 2 * n + 40]}, "none": {"dtype": "I8", "shape": [0], "data_offsets": [2 * n + 40, 2 * n + 40]}}
    raw = json.dumps(header).encode()
    with open(tmp_path / "large.tensors", "wb") as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for place, value in ((0, 3.0), (n // 2, -4.0), (n - 1, 12.0)):
            out.seek(8 + len(raw) + 2 * place)
            out.write(np.array([value], "<f2").tobytes())
        out.seek(8 + len(raw) + 2 * n)
        out.write(small.tobytes())
    path = f"file://{tmp_path}/large.tensors"
    ranges = tensors.tensor_ranges(spark, path).collect()
    assert sum(r.length for r in ranges if r.name == "big") == 2 * n and len(ranges) == 37
    found = tensors.tensor_moments(spark, path)
    assert found.rdd.getNumPartitions() > 0
    got = {r.name: r for r in found.collect()}
    assert (got["big"].n, got["big"].ok, got["big"].zeros, got["big"].a, got["big"].q, got["big"].m) == (n, n, n - 3, 19.0, 169.0, 12.0)
    assert (got["small"].n, got["small"].ok, got["small"].zeros, got["small"].a, got["small"].q, got["small"].m) == (5, 3, 1, 3.0, 5.0, 2.0)
    (whole,) = numeric.health(found).collect()
    assert (whole.tensors, whole.elements, whole.nonfinite_elements, whole.max_abs) == (3, n + 5, 2, 12.0)
    assert whole.mean_abs == pytest.approx(22.0 / (n + 3))


def test_slices_are_the_tensor(spark, tmp_path):
    values = np.arange(1000, dtype="<f4")
    header = json.dumps({"a": {"dtype": "F32", "shape": [10, 100], "data_offsets": [0, 4000]}}).encode()
    (tmp_path / "m.tensors").write_bytes(len(header).to_bytes(8, "little") + header + values.tobytes())
    rows = sorted(tensors.tensor_slices(spark, f"file://{tmp_path}/m.tensors", 256).collect(), key=lambda r: r.first)
    assert len(rows) == 16 and [r.first for r in rows] == list(range(0, 1000, 64))
    assert [x for r in rows for x in r["values"]] == values.tolist()
    whole = files.read_tensors(spark, str(tmp_path / "m.tensors"))
    (sliced,), (plain,) = numeric.health(tensors.tensor_moments(spark, f"file://{tmp_path}/m.tensors", 256)).collect(), numeric.tensor_health(whole, "values").collect()
    assert sliced.asDict() == pytest.approx(plain.asDict())
    (tmp_path / "m.tensors").write_bytes((tmp_path / "m.tensors").read_bytes()[:-9])
    with pytest.raises(Exception, match="ends within a tensor"):
        tensors.tensor_moments(spark, f"file://{tmp_path}/m.tensors", 256).collect()


def test_places_in_files_of_many_ranges(spark, tmp_path):
    rng = random.Random(2)
    plain, count = [], 0
    for name in ("b.txt", "a.txt", "c.txt"):
        own = ["".join(rng.choice("xyz é") for _ in range(rng.choice([0, 3, 90]))) for _ in range(rng.randrange(200, 400))]
        (tmp_path / name).write_text("\n".join(own) + ("\n" if name != "a.txt" else ""), encoding="utf-8")
    for name in ("a.txt", "b.txt", "c.txt"):
        for k, line in enumerate((tmp_path / name).read_text(encoding="utf-8").splitlines()):
            plain.append((name, k + 1, count, line))
            count += 1
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for most in ("97", "4096", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = jsonl.lines(spark, str(tmp_path), numbered=True)
            ranges = got.rdd.getNumPartitions()
            assert most != "97" or ranges > 50
            assert sorted((r.file.rsplit("/", 1)[1], r.line, r.source_index, r.value) for r in got.collect()) == plain
        finally:
            for c, v in old.items():
                spark.conf.set(c, v)


def ints(spark, path, *ranges, mode="append"):
    for low, high in ranges:
        spark.range(low, high, 1, 1).withColumnRenamed("id", "source_index").write.mode(mode).parquet(path)


def run_batches(spark, tmp_path, mark, handle=lambda b: b, per_batch=1):
    stream = spark.readStream.schema("source_index long").option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    batches.handle_available(stream, handle, str(tmp_path / "out"), str(tmp_path / mark)).awaitTermination()


def keys(spark, tmp_path):
    return sorted(r.source_index for r in batches.committed(spark, str(tmp_path / "out")).collect())


def test_micro_batches_are_taken_up_again(spark, tmp_path):
    ints(spark, str(tmp_path / "in"), (0, 5), (3, 8))  # three keys come twice
    run_batches(spark, tmp_path, "c1")
    assert keys(spark, tmp_path) == list(range(8))
    ints(spark, str(tmp_path / "in"), (8, 12), (2, 9))
    run_batches(spark, tmp_path, "c1")
    assert keys(spark, tmp_path) == list(range(12))
    run_batches(spark, tmp_path, "c2", per_batch=3)  # a lost checkpoint: all input comes again, in other batches
    assert keys(spark, tmp_path) == list(range(12))
    ints(spark, str(tmp_path / "in"), (12, 14))
    run_batches(spark, tmp_path, "c2")
    run_batches(spark, tmp_path, "c1")  # the old checkpoint is found again
    assert keys(spark, tmp_path) == list(range(14))


def test_a_batch_that_breaks_off(spark, tmp_path):
    ints(spark, str(tmp_path / "in"), (0, 4), (4, 9), (9, 12))

    def broken(batch):
        if batch.where("source_index = 5").count():
            raise RuntimeError("no more power")
        return batch

    with pytest.raises(Exception, match="no more power"):
        run_batches(spark, tmp_path, "c", broken)
    assert keys(spark, tmp_path) == list(range(4))
    # What a broken batch had written does not count, and is replaced.
    ints(spark, str(tmp_path / "out" / "run=0" / "batch=1"), (100, 103))
    assert keys(spark, tmp_path) == list(range(4))
    run_batches(spark, tmp_path, "c")
    assert keys(spark, tmp_path) == list(range(12))
    # A commit that Spark's own checkpoint does not know yet: the batch comes again and is left alone.
    for log in (tmp_path / "c" / "commits").glob("*2*"):
        log.unlink()
    run_batches(spark, tmp_path, "c")
    assert keys(spark, tmp_path) == list(range(12))


def test_work_of_a_batch_does_not_grow(spark, tmp_path, monkeypatch):
    ints(spark, str(tmp_path / "in"), *((k, k + 10) for k in range(0, 120, 10)))
    read = []
    real = batches.left_over

    def spied(batch, out, earlier, key):
        least, most = batch.agg({key: "min"}).first()[0], batch.agg({key: "max"}).first()[0]
        read.append(sum(c.rows for c in earlier if least is not None and c.meets(least, most)))
        return real(batch, out, earlier, key)

    monkeypatch.setattr(batches, "left_over", spied)
    run_batches(spark, tmp_path, "c1")
    assert read == []  # nothing that was done before is read
    run_batches(spark, tmp_path, "c2")
    assert len([n for n in read if n]) == 12 and max(read) == 10  # the tenth batch reads as much as the first
    assert keys(spark, tmp_path) == list(range(120))


def test_records_without_a_key_are_refused(spark, tmp_path):
    spark.createDataFrame([(1,), (None,)], "source_index long").write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="has no source_index"):
        run_batches(spark, tmp_path, "c")


def test_merged_parts_are_one_ordered_file(spark, tmp_path):
    parts = [spark.createDataFrame([(i, f"t{i}") for i in range(k, 10, 3)], "source_index long, t string") for k in range(3)]
    assert jsonl.write_merged(parts, str(tmp_path / "m")) == 10
    (part,) = (tmp_path / "m").glob("part-*")
    assert [json.loads(x)["source_index"] for x in part.read_text().splitlines()] == list(range(10))


def test_ordered_files_are_the_one_file(spark, tmp_path):
    rng = random.Random(5)
    keys = rng.sample(range(1000), 300)
    parts = [spark.createDataFrame([(i, f"té{i}", None if i % 3 else "n") for i in keys[k::3]], "source_index long, t string, n string") for k in range(3)]
    jsonl.write_merged([*parts, parts[0].limit(3)], str(tmp_path / "one"))
    order = jsonl.write_ordered([*parts, parts[0].limit(3)], str(tmp_path / "many"), files=7).orderBy("place").collect()
    (one,) = (tmp_path / "one").glob("part-*")
    assert len(order) == 7 and b"".join((tmp_path / "many" / r.file).read_bytes() for r in order) == one.read_bytes()
    assert [r.first for r in order] == [sum(x.rows for x in order[:k]) for k in range(7)] and sum(r.rows for r in order) == 300
    want = sorted(keys)
    for first, last in ((0, 5), (100, 180), (290, 400), (0, 300), (300, 310)):
        got = jsonl.read_places(spark, str(tmp_path / "many"), "source_index long, t string, n string", first, last).collect()
        assert [r.source_index for r in got] == want[first:last]


def test_provenance(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    (got,) = provenance.run_record(spark, str(tmp_path), [str(tmp_path / "f")], "7, Some card, 9.9, 16 GB, 1.0\n\n8, Other card, 9.9, 16 GB, 1.0").collect()
    assert got.inputs[0].bytes == 3 and got.inputs[0].sha256 == hashlib.sha256(b"abc").hexdigest()
    assert [g.name for g in got.devices] == ["Some card", "Other card"] and got.code.commit == "" and not got.code.clean


def test_code_state():
    told = "# branch.oid 12ab\n# branch.head side\n# branch.upstream o/side\n1 .M N... 100644 100644 100644 aa bb src/a b.py\n2 R. N... 100644 100644 100644 aa bb R100 new name\told\n? loose file\n"
    assert provenance.parse_status(told) == provenance.CodeState("12ab", "side", ["src/a b.py", "new name", "loose file"])
    fresh = provenance.parse_status("# branch.oid (initial)\n# branch.head (detached)\n")
    assert fresh == provenance.CodeState() and not fresh.clean and provenance.CodeState("1", "m").clean
    assert provenance.code_state("/no/such/folder") == provenance.CodeState()
