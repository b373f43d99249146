import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.config import SOURCE_METRICS
from tracelake.operators import coverage, progress
from tracelake.sources import files, tables, telemetry

HEADER = "extra,power_draw_W,timestamp,utilization_gpu_pct,utilization_memory_pct,memory_used_MiB"


@pytest.fixture()
def csv_root(tmp_path):
    for name, lines in {
        "d1/10-nodeA.csv": ["x,1,5.0,10,20,30", "x,2,4.0,,bad,30", "x,3,6.0,1,1,1"],
        "d1/10-node-b.csv": [],
        "d2/11-n.csv": ["x,9,1.0,1,2,3"],
        "d2/readme.csv": ["x,9,1.0,1,2,3"],
        "d2/deep/12-n.csv": ["x,9,1.0,1,2,3"],
        "13-top.csv": ["x,9,1.0,1,2,3"],
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(tmp_path)


def test_scan_by_file_name(spark, csv_root):
    df = coverage.parse_metrics(telemetry.scan_telemetry(spark, csv_root))
    rows = df.orderBy("job_id", "seq").collect()
    assert [(r["job_id"], r["node_id"], r["timestamp"], r["power_draw_W"]) for r in rows] == [
        ("10", "d1/nodeA", 5.0, 1.0), ("10", "d1/nodeA", 4.0, 2.0), ("10", "d1/nodeA", 6.0, 3.0), ("11", "d2/n", 1.0, 9.0),
    ]
    assert rows[1]["utilization_gpu_pct"] is None and rows[1]["utilization_memory_pct"] is None
    nodes = {tuple(r)[:2] for r in telemetry.list_nodes(spark, csv_root).collect()}
    assert nodes == {("10", "d1/nodeA"), ("10", "d1/node-b"), ("11", "d2/n")}


def test_files_that_differ_or_cannot_be_read(spark, csv_root, tmp_path):
    names = HEADER.split(",")[1:]
    before = {(r["job_id"], r["node_id"], r["timestamp"], r["power_draw_W"]) for r in telemetry.scan_telemetry(spark, csv_root).collect()}
    odd = {
        "d3/20-turned.csv": ",".join(names[::-1]) + "\n" + "3,2,1,7.0,99\n",
        "d3/21-lacking.csv": ",".join(names[1:]) + "\n" + "7.0,1,2,3\n",
        "d3/22-empty.csv": "",
        "d3/23-marked.csv": "\ufeff" + ",".join(names) + ",more\n" + '5,8.0,1,2,3,"a,b"\n6,9.0\n',
        "d3/10-nodeA.csv": HEADER + "\nx,4,5.0,1,2,3\n",
    }
    for name, text in odd.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "d3" / "24-bytes.csv").write_bytes(bytes(range(128, 256)) * 40)
    rows = {(r["job_id"], r["node_id"], r["timestamp"], r["power_draw_W"]) for r in telemetry.scan_telemetry(spark, csv_root).collect()}
    assert rows - before == {
        ("20", "d3/turned", "7.0", "99"), ("23", "d3/marked", "8.0", "5"), ("23", "d3/marked", "9.0", "6"),
        ("10", "d3/nodeA", "5.0", "4"),
    }
    assert before <= rows
    listed = {r["node_id"] for r in telemetry.list_nodes(spark, csv_root).collect()}
    assert {"d3/lacking", "d3/empty", "d3/bytes"} <= listed
    some = telemetry.list_nodes(spark, csv_root).filter("job_id = '10'")
    assert {r["node_id"] for r in telemetry.ingest(some).samples.collect()} == {"d1/nodeA", "d3/nodeA"}


def states(status):
    return {(r["job_id"], r["node_id"]): (r["status"], r["n_rows"]) for r in status.collect()}


def test_state_of_every_file(spark, csv_root, tmp_path):
    """One read for any number of headers; a file that fails midway has a state and no row."""
    names = HEADER.split(",")[1:]
    (tmp_path / "d3").mkdir()
    for k in range(40):  # every file has a header of its own
        (tmp_path / "d3" / f"3{k:02d}-n.csv").write_text(",".join([f"x{k}", *names]) + f"\nx,{k},1.0,2,3,4\n")
    (tmp_path / "d3" / "20-lacking.csv").write_text(",".join(names[1:]) + "\n7.0,1,2,3\n")
    (tmp_path / "d3" / "21-empty.csv").write_text("")
    (tmp_path / "d3" / "22-short.csv").write_text(HEADER + '\nx,1\n"q\nr",2,3.0,4,5,6,7,8\n')
    nodes = telemetry.list_nodes(spark, csv_root)
    lost = spark.createDataFrame([("23", "d3/gone", f"{csv_root}/d3/23-gone.csv", 9), ("24", "d3/dir", f"{csv_root}/d3", 9)], nodes.schema)
    got = telemetry.ingest(nodes.union(lost))
    seen = states(got.status)
    assert {k: v for k, v in seen.items() if k[0] < "300"} == {
        ("10", "d1/nodeA"): ("ok", 3), ("10", "d1/node-b"): ("ok", 0), ("11", "d2/n"): ("ok", 1),
        ("20", "d3/lacking"): ("missing columns", 0), ("21", "d3/empty"): ("empty", 0), ("22", "d3/short"): ("ok", 2),
        ("23", "d3/gone"): ("unreadable", 0), ("24", "d3/dir"): ("unreadable", 0),
    }
    assert sum(v == ("ok", 1) for v in seen.values()) == 41
    rows = {(r["job_id"], r["power_draw_W"], r["timestamp"], r["memory_used_MiB"]) for r in got.samples.collect()}
    assert {("22", "1", None, None), ("22", "2", "3.0", "6"), ("307", "7", "1.0", "4")} <= rows
    assert not {r[0] for r in rows} & {"20", "21", "23", "24"}


def test_read_that_fails_midway(spark, tmp_path):
    """Spark checks local checksums, so a file that was changed behind them fails after good rows."""
    schema = "job_id string, node_id string, seq long, timestamp double, " + ", ".join(f"{c} double" for c in SOURCE_METRICS)
    df = spark.createDataFrame([(str(j), "a", i, float(i), 1.0, 2.0, 3.0, float(i)) for j in (1, 2) for i in range(20_000)], schema)
    path = str(tmp_path / "out")
    telemetry.write_telemetry(df, path)
    file = max((tmp_path / "out" / "unit=1-a").glob("*.csv"), key=lambda f: f.stat().st_size)
    content = bytearray(file.read_bytes())
    content[-9] ^= 1
    file.write_bytes(content)
    got = telemetry.ingest(telemetry.list_nodes(spark, path, "folder"), through_spark=True)
    seen = {(r["job_id"], r["path"].split("/")[-1]): r["status"] for r in got.status.collect()}
    assert [k for k, v in seen.items() if v != "ok"] == [("1", file.name)] and seen["1", file.name] == "unreadable"
    assert [tuple(r) for r in got.samples.groupBy("job_id").count().collect()] == [("2", 20_000)]


def test_node_of_several_files_needs_all(spark, tmp_path):
    for unit, part, text in (("5-a", 0, "good"), ("5-a", 1, ""), ("6-a", 0, "good"), ("6-a", 1, "good")):
        folder = tmp_path / f"unit={unit}"
        folder.mkdir(exist_ok=True)
        (folder / f"part-{part}.csv").write_text(HEADER + "\nx,1,2,3,4,5\n" if text else "")
    got = telemetry.scan_telemetry(spark, str(tmp_path), "folder").collect()
    assert [r["job_id"] for r in got] == ["6", "6"]


def test_probe_reads_heads_only(tmp_path):
    """The pieces that a probe takes do not depend on the length of the file."""
    taken = []
    for n in (3_000, 90_000):
        path = tmp_path / f"{n}.csv"
        path.write_text(HEADER + "\n" + "".join(f'"a\n{k}",1,{k}.5,2,3,4\n' for k in range(n)))
        pieces = files.read_pieces(str(path), 1_000)
        counted = []
        status, columns = telemetry.parse_head((counted.append(p) or p for p in pieces), 20)
        assert status == "ok" and columns[0].to_pylist() == [f"{k}.5" for k in range(20)]
        taken.append(sum(map(len, counted)))
    assert taken[0] == taken[1] <= 2_000
    for text, want in (("", ("empty", 0)), ("a,b\n1,2\n" * 50, ("missing columns", 0)), (HEADER, ("ok", 0)), (HEADER + "\nx,1,2,3,4,5", ("ok", 1))):
        status, columns = telemetry.parse_head(iter([text.encode()] if text else []), 20)
        assert (status, len(columns[0]) if columns else 0) == want


def test_outputs_are_checked_by_their_footers(spark, tmp_path):
    path = str(tmp_path / "t" / "run=1")
    spark.range(1_000, numPartitions=3).write.parquet(path)
    broken, *rest = sorted((tmp_path / "t" / "run=1").glob("*.parquet"))
    broken.write_bytes(broken.read_bytes()[:-20])
    listing = files.list_one_below(spark, str(tmp_path / "t")).filter("path LIKE '%.parquet'")
    rows = {r["path"]: r["rows"] for r in files.parquet_footers(listing).collect()}
    assert rows.pop(str(broken)) is None and sum(rows.values()) == 667
    assert {os.path.basename(r["path"]) for r in files.list_tree(spark, str(tmp_path)).collect()} == {broken.name, *(f.name for f in rest)}
    assert files.delete_files(listing.filter(F.col("path") == str(broken))) == 1 and not broken.exists()


def test_folder_layout_keeps_order(spark, tmp_path):
    schema = "job_id string, node_id string, seq long, timestamp double, " + ", ".join(f"{c} double" for c in SOURCE_METRICS)
    df = spark.createDataFrame([("1", "a", i, float((i * 7) % 50), 1.0, 2.0, 3.0, float(i)) for i in range(50)], schema)
    path = str(tmp_path / "out")
    telemetry.write_telemetry(df, path)
    back = coverage.parse_metrics(telemetry.scan_telemetry(spark, path, layout="folder")).orderBy("seq").collect()
    assert [r["power_draw_W"] for r in back] == [float(i) for i in range(50)]


SAMPLES = "job_id string, node_id string, seq long, timestamp double, " + ", ".join(f"{c} string" for c in SOURCE_METRICS)


def folders(root):
    """The text of every folder below a root, its files in their order; hidden entries are left out."""
    texts = {}
    for file in sorted(root.glob("*/*")):
        if not file.name.startswith(".") and not file.parent.name.startswith(("_", ".")):
            body = file.read_text().split("\n", 1)
            texts[file.parent.name] = [body[0], texts.get(file.parent.name, ["", ""])[1] + body[1]]
    return texts


def written_by_spark(df, path, columns):
    rows = df.withColumn("unit", F.concat_ws("-", "job_id", "node_id")).repartitionByRange(4, "unit", "seq")
    rows = rows.sortWithinPartitions("unit", "seq").select("unit", *columns)
    rows.write.mode("append").partitionBy("unit").option("header", True).csv(path)


def test_written_as_by_spark(spark, tmp_path):
    """Folders, headers and rows are those of Spark's writer, and its checks of local files hold."""
    texts = ["a", "", None, ' b "q" ', "x,y", "l\nm", "\u00e4\u4e2d", "\\", "#c", "'"]
    rows = [("7", "heavy", i, i / 7, "1", texts[i % 10], None, "2") for i in range(25_000)]
    rows += [("8", n, 0, float("nan"), *["1"] * 4) for n in ("a b", "c/d=e%", "\u00e4", "", "{[x]}?*:", None)]
    rows += [(None, None, 0, float("inf"), None, "", None, None), (None, "n", 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SAMPLES)
    names = ["power_draw_W", "timestamp", *SOURCE_METRICS[:2]]
    for part in (df, df.filter("job_id = '7' AND seq < 3"), df.filter("false")):  # the second is put beside the first
        telemetry.write_telemetry(part, str(tmp_path / "ours"), names)
        written_by_spark(part, str(tmp_path / "spark"), names)
    got, want = folders(tmp_path / "ours"), folders(tmp_path / "spark")
    assert got.keys() == want.keys() and len(got) == 9
    assert {k: (h, sorted(t)) for k, (h, t) in got.items()} == {k: (h, sorted(t)) for k, (h, t) in want.items()}
    assert {k: v for k, v in got.items() if k != "unit=7-heavy"} == {k: v for k, v in want.items() if k != "unit=7-heavy"}
    assert [f.name for f in (tmp_path / "ours").iterdir() if f.name.startswith("_")] == ["_SUCCESS"]
    files_of = list((tmp_path / "ours").glob("unit=*/[!.]*"))
    assert all((f.parent / f".{f.name}.crc").exists() for f in files_of)
    assert spark.read.text(str(tmp_path / "ours")).count() > 25_000
    ours = telemetry.scan_telemetry(spark, str(tmp_path / "spark"), "folder").count()
    assert ours == telemetry.scan_telemetry(spark, str(tmp_path / "ours"), "folder").count()


def test_write_that_fails_leaves_nothing(spark, tmp_path):
    fails = F.udf(lambda k: str(1 // (k - 900)), "string")
    lines = spark.range(1_000, numPartitions=2).select(F.col("id").cast("string").alias("value"), fails("id").alias("line"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        files.append_folders(lines, str(tmp_path / "out"), "unit", ["a"])
    assert not list(tmp_path.glob("out/*"))


def test_moves_can_be_repeated(tmp_path):
    """A second task finds folders and files that the first has moved; two parts of a folder are put together."""
    rows = {"staged": [], "folder": [], "name": []}
    for part in ("0-1", "1-2"):
        folder = tmp_path / "stage" / part / "unit=5-a"
        folder.mkdir(parents=True)
        for name in (f"{part}.csv", f".{part}.csv.crc"):
            (folder / name).write_text(part)
        for column, value in zip(rows.values(), (str(folder), "unit=5-a", f"{part}.csv")):
            column.append(value)
    (tmp_path / "root").mkdir()
    for _ in range(2):
        list(files._mover(str(tmp_path / "root"))([pa.RecordBatch.from_pydict(rows)]))
    assert {f.name for f in (tmp_path / "root" / "unit=5-a").iterdir()} == {"0-1.csv", ".0-1.csv.crc", "1-2.csv", ".1-2.csv.crc"}


def test_entries_of_a_local_folder(tmp_path):
    """One by one, as the store lists them at once; hidden entries, links to nothing and folders that are gone give none."""
    (tmp_path / "f").write_text("abc")
    (tmp_path / "d" / "e").mkdir(parents=True)
    for hidden in ("_SUCCESS", ".f.crc"):
        (tmp_path / hidden).write_text("x")
    for link, target in (("lf", "f"), ("ld", "d"), ("lost", "none")):
        (tmp_path / link).symlink_to(tmp_path / target)
    (batch,) = files._list([pa.RecordBatch.from_pydict({"path": [f"file:{tmp_path}", f"{tmp_path}/none", f"{tmp_path}/d/"]})])
    want = {("f", 3, False), ("d", 0, True), ("lf", 3, False), ("ld", 0, True)}
    assert {tuple(r.values()) for r in batch.to_pylist()} == {(f"file:{tmp_path}/{n}", b, d) for n, b, d in want} | {(f"{tmp_path}/d/e", 0, True)}


def test_many_units_take_little_time(spark, tmp_path):
    """Spark's writer takes the driver through all files; tasks need a part of its time."""
    columns = [F.concat(F.col("id") % 3_000, F.lit("")).alias("job_id"), F.lit("a").alias("node_id"), F.col("id").alias("seq")]
    df = spark.range(12_000).select(*columns, *[F.col("id").cast("double").alias(c) for c in telemetry.COLUMNS])
    took = []
    for write in (written_by_spark, telemetry.write_telemetry):
        start = time.perf_counter()
        write(df, str(tmp_path / write.__name__), telemetry.COLUMNS)
        took.append(time.perf_counter() - start)
    assert folders(tmp_path / "written_by_spark") == folders(tmp_path / "write_telemetry")
    assert took[1] < took[0] * 0.7


def test_small_files_share_a_pass(monkeypatch):
    head, passes, plain = ",".join(telemetry.COLUMNS).encode(), [], telemetry._arrow_columns
    monkeypatch.setattr(telemetry, "_arrow_columns", lambda *a: passes.append(a) or plain(*a))
    texts = lambda found: [(s, [c.to_pylist() for c in columns]) for s, columns in found]
    good = [head + b"\n" + b"%d,2,,4,5\n" % k * (k % 3) for k in range(500)] + [head + b',m\n1,2,3,4,5,"x,y"\n'] * 500
    found = telemetry.parse_all(good)
    assert len(passes) == 2
    assert texts(found) == texts([telemetry.parse_csv(c) for c in good])
    bodies = [
        b"", b"\n1,2,3,4,5", b"\r\n1,2,3,4,5\r\n", b'\n1,2,3,4,"5\n', b'\n1,2,3,4,"a\nb"\n6,7,8,9,0\n', b"\n1,2\n", b"\n1,2,3,4,5,6\n",
        b'\n1,,"",4,5\n\n2,2,2,2,2\n', b"\n  \n1,2,3,4,5\n", b"\n\xff,2,3,4,5\n", b"\n\xef\xbb\xbf1,2,3,4,5\n", b'\n1,2,3,4,a"b,"c\n6,7,8,9,0\n', b"\n,,,,\n",
    ]
    odd = [head + body for body in bodies] + [b"", b"\n", b"a,b\n1,2\n", b"\xef\xbb\xbf" + head + b"\n1,2,3,4,5\n"]
    for one in odd:
        for some in ([one, good[1]], [good[1], one, good[2]], odd):
            assert texts(telemetry.parse_all(some)) == texts([telemetry.parse_csv(c) for c in some])


def test_scheduler_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(
        "user,id_job,cpus_req,mem_req,priority,state,job_type,time_start\n"
        "u,7,2,1e9,12000.5,3,OTHER,1640995200\nu,8,4.0,,5,,LLSUB:BATCH,oops\n"
    )
    rows = tables.scan_scheduler(spark, str(path)).orderBy("id_job").collect()
    assert tuple(rows[0]) == (7, 2, 1e9, 12000.5, 3, "OTHER", 1640995200)
    assert tuple(rows[1]) == (8, 4, None, 5.0, None, "LLSUB:BATCH", None)
    bad = tmp_path / "b.csv"
    bad.write_text("id_job\n1\n")
    with pytest.raises(KeyError, match="cpus_req"):
        tables.scan_scheduler(spark, str(bad))


def test_trace_table_and_manifest(spark, tmp_path):
    rows = [(str(j), k, k * 0.1, 1.0, 2.0, 3.0, 4.0) for j in range(3) for k in range(5)]
    df = spark.createDataFrame(rows, "job_id string, k long, timestamp double, gpu_used_pct float, memory_used_pct float, memory_used_MiB float, power_draw_W float")
    path = str(tmp_path / "traces")
    tables.write_traces(df, path)
    assert sorted(map(tuple, tables.read_traces(spark, path).collect())) == sorted(map(tuple, df.collect()))
    listed = telemetry.list_files(spark, path, "*.parquet").collect()
    assert listed and all(r["bytes"] == os.path.getsize(r["key"].replace("file:", "")) for r in listed)
    with pytest.raises(Exception, match="already exists"):
        tables.write_traces(df, path)


def test_resume_and_fetch(spark):
    units = spark.createDataFrame([(f"k{i:02d}",) for i in range(10)], "key string")
    manifest = spark.createDataFrame([("k00", 300), ("k01", 10)], "key string, bytes long")
    pending = progress.pending_units(units, manifest, 256)
    assert sorted(r[0] for r in pending.collect()) == [f"k{i:02d}" for i in range(1, 10)]
    assert tuple(progress.progress_counts(units, pending).first()) == (1, 9)
    plan = progress.fetch_plan(units, manifest, 4)
    assert [(r["batch_no"], r["status"]) for r in plan.orderBy("key").collect()] == [
        (i // 4, "skipped" if i < 2 else "downloaded") for i in range(10)
    ]
    totals = {(r["batch_no"], r["status"]): r["n"] for r in progress.fetch_totals(plan).collect()}
    assert totals[(0, "skipped")] == 2 and totals[(2, "downloaded")] == 2


def test_phase_report(spark):
    one = spark.range(3).agg(F.count("*").alias("loaded"), F.max("id").alias("top"))
    got = {tuple(r) for r in progress.phase_report({"a": one, "b": one.select("top")}).collect()}
    assert got == {("a", "loaded", 3), ("a", "top", 2), ("b", "top", 2)}
