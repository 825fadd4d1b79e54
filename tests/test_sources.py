"""Readers, landing audit, stored tables and streams on small files."""

import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from oddledger.errors import IngestError
from oddledger.operators.detectors import get
from oddledger import session
from oddledger.operators.transform import transform, transformation_stats
from oddledger.session import scratch, temporary
from oddledger.sources import landing, readers, tables
from oddledger.streaming.ingest import start_ingest
from tests.test_groups import skewed

CSV = """amount,timestamp,account_id,external_transaction_id
7.25, 2022-06-30T08:15:00Z ,K-17,R9
-3.10,2022-06-30T08:40:00Z,K-17,
61.00,2022-07-01T23:05:00Z,K-20,R11
"""


def test_csv_rows_numbers_and_trim(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text(CSV)
    found = readers.read_csv(spark, str(tmp_path)).orderBy("_source_file", "_row_number").collect()
    assert [(r["_source_file"], r["_row_number"]) for r in found] == [
        (f, i) for f in ("a.csv", "b.csv") for i in (1, 2, 3)
    ]
    assert found[0]["timestamp"] == "2022-06-30T08:15:00Z"
    assert found[1]["external_transaction_id"] is None


def test_csv_row_numbers_over_many_blocks(spark, tmp_path):
    lines = ["n,account_id"] + [f"{i},ACC{i % 7}" for i in range(1, 20001)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = readers.read_csv(spark, str(tmp_path))
        assert df.filter(F.col("n").cast("long") != F.col("_row_number")).count() == 0
        assert df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def csv_by_row(spark, path, **options):
    found = readers.read_csv(spark, str(path), **options)
    rows = found.orderBy("_source_file", "_row_number").collect()
    return found.columns, [r.asDict() for r in rows]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,account_id,timestamp,amount\n1,A,2024-01-01,5\n")
    (tmp_path / "b.csv").write_text("\ufeffaccount_id,ID,amount,timestamp,extra\nB,2,7,2024-01-02,x\nC,3\n")
    (tmp_path / "c.csv").write_text("\n\nid\n9\n")
    columns, rows = csv_by_row(spark, tmp_path)
    assert columns[:5] == ["id", "account_id", "timestamp", "amount", "extra"]
    got = [tuple(r[c] for c in columns[:5]) for r in rows]
    assert got == [
        ("1", "A", "2024-01-01", "5", None),
        ("2", "B", "2024-01-02", "7", "x"),
        ("3", "C", None, None, None),
        ("9", None, None, None, None),
    ]


def python_csv(path):
    with open(path, newline="", encoding="utf-8") as f:
        return [
            {k: (v.replace("\r\n", "\n").strip(" ") or None) for k, v in r.items()} for r in csv.DictReader(f)
        ]


def quoted_file(path, seed, rows=400):
    """Values with separators, quotes, doubled quotes and line breaks, among plain ones."""
    draw = random.Random(seed)
    pieces = ['a', 'b,c', 'say ""so""', 'x\ny', '\n', ' ', 'end', '5']
    lines = ["id,text,more"]
    for i in range(rows):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 5)))
        value = f'"{text}"' if draw.random() < 0.5 else draw.choice(["plain", "", 'it is 5" long'])
        lines.append(f"{i},{value},{draw.choice(['', 'z', '\"q\"'])}")
        if draw.random() < 0.05:
            lines.append("")
    path.write_text("\n".join(lines) + "\n")


@pytest.mark.parametrize("size", ["256", "4k", "128m"])
def test_csv_line_breaks_in_quotes(spark, tmp_path, monkeypatch, size):
    """Against Python's reader, at any cut of the file."""
    for seed in range(3):
        quoted_file(tmp_path / f"{seed}.csv", seed)
    monkeypatch.setattr(readers, "RUN_LINES", 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        _, rows = csv_by_row(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [r for seed in range(3) for r in python_csv(tmp_path / f"{seed}.csv")]
    assert [{k: r[k] for k in ("id", "text", "more")} for r in rows] == [
        {k: None if not (v or "").strip() else v.strip() for k, v in r.items()} for r in want
    ]
    assert [r["_row_number"] for r in rows] == [*range(1, 401)] * 3


def test_csv_quote_that_nothing_closes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "RECORD_LINES", 5)
    (tmp_path / "a.csv").write_text('id,text\n1,"open\n' + "".join(f"{i},x\n" for i in range(2, 30)))
    _, rows = csv_by_row(spark, tmp_path)
    assert [r["id"] for r in rows] == [str(i) for i in range(1, 30)]


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount\n")
    assert readers.read_csv(spark, str(tmp_path)).columns[:2] == ["id", "amount"]
    assert readers.read_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text("\n\n")
    assert readers.read_csv(spark, str(tmp_path)).count() == 0


def test_json_rejects(spark, tmp_path):
    good = ['{"id": 1, "amount": 2}', '{"id": 3}', '{"id": 4, "nested": {"a": 1}}']
    (tmp_path / "cut off [1].json").write_text("\n".join([good[0], '{"id": 2, "amo', *good[1:]]))
    (tmp_path / "first.json").write_text('{"id": 5, "am\n{"id": 6}\n{"id": 7}\n')
    (tmp_path / "doc.json").write_text('{\n "transactions": [\n{"id": 8},\n{"id": 9}\n]\n}')
    (tmp_path / "bad.json").write_text('[{"id": 10},')
    rows, rejects = readers.read_json_parts(spark, str(tmp_path))
    assert sorted(r["id"] for r in rows.collect()) == ["1", "3", "4", "6", "7", "8", "9"]
    found = sorted((r["_source_file"][:3], r["_row_number"], r["text"].strip()) for r in rejects.collect())
    assert found == [("bad", 1, '[{"id": 10},'), ("cut", 2, '{"id": 2, "amo'), ("fir", 1, '{"id": 5, "am')]
    stats = transformation_stats(rows, rows.selectExpr(
        "current_timestamp() as timestamp", "1.0 as amount", "id as account_id"), rejects).first()
    assert (stats["original_count"], stats["rejected_count"]) == (7, 3)


def test_csv_delimiter_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("belopp;konto\n1,5;Ärende\n".encode("latin-1"))
    row = readers.read_csv(spark, str(tmp_path), ";", "ISO-8859-1").first()
    assert (row["belopp"], row["konto"]) == ("1,5", "Ärende")


ROWS = [{"amount": 1.5, "account_id": "A"}, {"amount": 2, "account_id": "B"}]


@pytest.mark.parametrize(
    "content,rows", [(ROWS, 2), ({"transactions": ROWS, "bank": "x"}, 2), (ROWS[0], 1)]
)
def test_json_shapes(spark, tmp_path, content, rows):
    (tmp_path / "a.json").write_text(json.dumps(content))
    found = readers.read_json(spark, str(tmp_path)).orderBy("_row_number").collect()
    assert [r["account_id"] for r in found] == ["A", "B"][:rows]
    assert [r["_row_number"] for r in found] == [1, 2][:rows]
    assert found[0]["_source_file"] == "a.json"


def test_xml_attributes_children_and_repeats(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<bank><day><transaction id="T1"><amount>5.5</amount><tag>x</tag><tag>y</tag></transaction></day>'
        '<transaction id="T2"><amount>7</amount></transaction></bank>'
    )
    found = readers.read_xml(spark, str(tmp_path)).orderBy("_row_number").collect()
    assert [(r["id"], r["amount"]) for r in found] == [("T1", "5.5"), ("T2", "7")]
    assert found[0]["tag"] == ["x", "y"]


def test_unknown_file_type(spark):
    with pytest.raises(IngestError):
        readers.read_transactions(spark, "/nowhere", "sie4")


def test_required_columns(spark):
    df = spark.createDataFrame([("1", "2")], "Amount string, TIMESTAMP string")
    found = readers.check_required_columns(df, "csv")
    assert found["missing_columns"] == ["account_id"] and not found["valid"]
    assert readers.check_required_columns(df, "json")["valid"]


def test_landing_audit(spark, tmp_path):
    (tmp_path / "ok.csv").write_text(CSV)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.json").write_text('{"amount": ')
    (tmp_path / "good.json").write_text(json.dumps(ROWS))
    (tmp_path / "notes.txt").write_text("hello")
    (tmp_path / "noending").write_text("hello")
    (tmp_path / "a..b.csv").write_text(CSV)
    (tmp_path / "long.csv").write_text(CSV * 20)
    found = {
        r["file"]: r for r in landing.audit_landing(spark, str(tmp_path), max_bytes=1000).collect()
    }
    assert found["ok.csv"]["valid"] and found["good.json"]["valid"]
    assert found["empty.csv"]["errors"] == ["file.empty"]
    assert found["bad.json"]["errors"] == ["content.broken: json"]
    assert "file.type" in found["notes.txt"]["errors"][0]
    assert found["noending"]["warnings"] == ["name.no_ending"]
    assert found["a..b.csv"]["errors"] == ["name.part: .."]
    assert "file.size" in found["long.csv"]["errors"][0]
    assert found["bad.json"]["rejected"] == 1 and found["good.json"]["rejected"] == 0


def test_scores_and_flags_tables(spark):
    df = skewed(spark, 600)
    result = get("rule_based", "weekend_threshold").run(df)
    path = scratch(spark, "flags")
    tables.write_rule_flags(result, path, "r1")
    tables.write_rule_flags(result, path, "r2")
    tables.write_rule_flags(result, path, "r2")  # a repeated job stores once
    assert spark.read.parquet(path).count() == 2 * 3 * 600
    assert tables.read_run(spark, path, "r1").count() == 3 * 600


def test_stream_ingest_is_incremental(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    (source / "one.csv").write_text(CSV)
    schema = "amount string, timestamp string, account_id string, external_transaction_id string"
    kind = spark.createDataFrame([], schema).schema
    start_ingest(spark, str(source), out, progress, kind).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    (source / "two.csv").write_text(CSV)
    start_ingest(spark, str(source), out, progress, kind).awaitTermination()
    stored = tables.load_transactions(spark, out)
    assert stored.count() == 6
    assert stored.select("id").distinct().count() == 6
    assert stored.select("upload_id").distinct().count() == 2
    # the sequence restarts with every upload
    assert stored.agg(F.max("transaction_sequence")).first()[0] == 2


@pytest.mark.parametrize(
    "conf,before,after",
    [
        ("spark.sql.files.maxPartitionBytes", "16k", "128m"),
        ("spark.sql.leafNodeDefaultParallelism", "4", "16"),
    ],
)
def test_rows_do_not_depend_on_how_files_are_split(spark, tmp_path, conf, before, after):
    """The cut of a file into blocks may change between reading and using it."""
    (tmp_path / "big.csv").write_text("n,text\n" + "".join(f"{i},row {i}\n" for i in range(1, 20001)))
    spark.conf.set(conf, before)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = readers.read_csv(spark, str(tmp_path))
        spark.conf.set(conf, after)
        assert df.count() == 20000
        assert df.filter(F.col("n").cast("long") != F.col("_row_number")).isEmpty()
    finally:
        spark.conf.unset(conf)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_lines(spark, tmp_path):
    lines = "\n".join(f'{{"id": "{i}", "amount": {i}.5}}' for i in range(1, 11))
    (tmp_path / "a.json").write_text(lines + "\n")
    found = readers.read_json(spark, str(tmp_path)).orderBy("_row_number").collect()
    assert [(r["id"], r["amount"], r["_row_number"]) for r in found] == [
        (str(i), f"{i}.5", i) for i in range(1, 11)
    ]


def test_json_files_of_all_shapes_side_by_side(spark, tmp_path):
    (tmp_path / "wrapped.json").write_text('{"exported": "today", "transactions": [{"id": "1", "amount": "5"}]}')
    (tmp_path / "plain.json").write_text('[{"referens": "2", "belopp": "6"}, {"referens": "3", "belopp": "7"}]')
    (tmp_path / "lines.json").write_text('{"id": "4", "amount": "8"}\n{"id": "5", "amount": "9"}\n')
    found = readers.read_json(spark, str(tmp_path))
    assert set(found.columns) == {
        "id", "amount", "referens", "belopp", "_source_file", "_source_path", "_row_number"
    }
    ids = F.coalesce("id", "referens")
    assert [r[0] for r in found.select(ids.alias("i")).orderBy("i").collect()] == list("12345")


def test_equal_file_names_in_two_folders(spark, tmp_path):
    for folder, amount in (("a", "1.0"), ("b", "2.0")):
        (tmp_path / folder).mkdir()
        rows = f"{amount},2024-01-01,ACC1\n{amount},2024-01-02,ACC1\n"
        (tmp_path / folder / "tx.csv").write_text("amount,timestamp,account_id\n" + rows)
    raw = readers.read_csv(spark, f"{tmp_path}/*")
    found = transform(raw).collect()
    assert len({r["id"] for r in found}) == len(found) == 4


def test_partition_values_stay_text_and_scores_have_no_bound(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "a", "z", 25_000.0, 1.0, "{}")], "transaction_id string, "
        "algorithm_type string, algorithm_name string, score double, confidence double, metadata string")
    path = str(tmp_path / "scores")
    tables.write_scores(rows, path, "007")
    assert tables.read_run(spark, path, "u-1").count() == 0
    row = tables.read_run(spark, path, "007").first()
    assert (row["run_id"], row["score"]) == ("007", 25_000.0)


def test_scratch_is_empty_after_a_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tx.csv").write_text("amount,timestamp,account_id\n1,2024-01-01,A\n2,2024-01-02,A\n")
    with temporary(spark):
        df = transform(readers.read_csv(spark, str(tmp_path / "in")), upload_id="u")
        tables.write_transactions(df, str(tmp_path / "out"))
        made = list(session._scopes[-1])
    assert made and not any(os.path.exists(p.removeprefix("file:")) for p in made)
    assert tables.load_transactions(spark, str(tmp_path / "out"), "u").count() == 2


def test_retention_removes_only_what_expired(spark, tmp_path):
    from oddledger.plans import serve

    path = str(tmp_path / "stored")
    ids = ["old 1", "old/2", "new", "007"]
    rows = skewed(spark, 200).withColumn(
        "upload_id", F.element_at(F.array(*[F.lit(i) for i in ids]), F.abs(F.hash("id")) % 4 + 1)
    )
    tables.write_transactions(rows, path)
    times = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-02-09 00:00:00", "2024-02-01 00:00:00"]
    uploads = spark.createDataFrame([*zip(ids, times, strict=True), ("never stored", times[0])], "id string, at string").select(
        "id", F.col("at").cast("timestamp").alias("upload_timestamp")
    )

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}

    before = files()
    assert serve.remove_expired(spark, uploads, path, "2024-02-10") == 2
    after = files()
    assert after and all(before[f] == t for f, t in after.items())
    left = {r[0] for r in tables.load_transactions(spark, path).select("upload_id").distinct().collect()}
    assert left == {"new", "007"}
    # a run that is repeated finds nothing more
    assert serve.remove_expired(spark, uploads, path, "2024-02-10") == 0


def test_pages_behind_a_row_make_up_the_whole(spark):
    from oddledger.plans import serve

    df = skewed(spark, 300).withColumn("amount", F.when(F.hash("id") % 5 != 0, F.floor("amount") % 7))
    for order in ("asc", "desc"):
        want = [r["id"] for r in serve.page(df, "amount", order, 1, 1000).collect()]
        got, after = [], None
        while rows := serve.page_after(df, after, "amount", order, 60).collect():
            got += [r["id"] for r in rows]
            after = (rows[-1]["amount"], rows[-1]["id"])
        assert got == want
        assert [r["id"] for r in serve.far_page(df, "amount", order, 4, 40).collect()] == want[120:160]
