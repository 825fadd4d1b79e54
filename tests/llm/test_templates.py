"""Decontamination: planted items, changed values, chance meetings."""

from oddledger.llm import templates

ITEM = "A train leaves Paris at 9 with 120 passengers and travels 300 km before it stops in Lyon, how long does it take?"
CHANGED = ITEM.replace("Paris", "Berlin").replace("Lyon", "Munich").replace("300 km", "450 miles")
TWISTED = "Tom has 3 apples and Ann has 3 pears and Tom eats 3 plums for lunch today"
BENCH = [(1, ITEM), (2, TWISTED), (3, "short one"), (4, None), (5, ""), (None, ITEM), (6, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich und lachen")]


def found(spark, documents, rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = templates.decontaminate(documents(rows), bench).collect()
    return {r["doc_id"]: (r["contaminated"], r["item_id"], r["changed"]) for r in got}


def test_items_and_changed_items(spark, documents):
    filler = "nothing of this belongs to any question in the list. " * 5
    got = found(
        spark,
        documents,
        [
            (10, filler),
            (11, filler + ITEM + " " + filler),
            (12, filler + CHANGED + filler),
            (13, "and then " + BENCH[-1][1] + ", they say"),
            (14, TWISTED.replace("3 apples", "4 apples")),
            (15, TWISTED.replace("3", "8")),
            (16, "short one"),
            (17, "this is a short one indeed"),
            (18, None),
            (19, ""),
            (None, ITEM),
        ],
    )
    assert got[10] == (False, None, 0)
    assert got[11] == (True, 1, 0)
    assert got[12][:2] == (True, 1) and got[12][2] == 4
    assert got[13] == (True, 6, 0)
    # one value of the item stands for two in the document
    assert not got[14][0]
    assert got[15] == (True, 2, 1)
    assert got[16][:2] == (True, 3)
    assert not got[17][0] and not got[18][0] and not got[19][0]
    assert got[None][0]


def test_clean_keeps_columns_and_null_ids(spark, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = documents([(1, ITEM), (None, "plain text"), (None, ITEM), (2, None)])
    kept = templates.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "plain text"), (2, "")]


def test_awkward_and_empty(spark, awkward, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert templates.decontaminate(awkward, bench).count() == awkward.count()
    assert templates.decontaminate(documents([]), bench).count() == 0
    assert templates.decontaminate(awkward, bench.limit(0)).filter("contaminated").count() == 0


def test_shuffle_join_gives_the_same(spark, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = documents([(1, ITEM), (2, CHANGED), (3, "other")])
    p = templates.Templates(broadcast_rows=0)
    assert sorted(map(tuple, templates.decontaminate(docs, bench, p).collect()), key=str) == sorted(
        map(tuple, templates.decontaminate(docs, bench).collect()), key=str
    )


def test_no_python_in_the_plan(spark, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    plan = templates.decontaminate(documents([(1, ITEM)]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_items_of_few_literal_words_are_found_with_their_values(spark, documents):
    few = "Who wrote Hamlet in 1603?"
    many = "Did Anna Smith meet Paul Jones in Rome on 12 May 1999?"
    bench = spark.createDataFrame([(1, few), (2, many), (3, "Meet Anna")], "item_id long, text string")
    rows = [
        (10, few),
        (11, many),
        (12, f"They were asked: {few} {many} and more of that."),
        (13, "Who wrote Faust in 1808?"),
        (14, many.replace("Rome", "Bonn")),
        (15, "meet anna"),
        (16, "They meet Anna"),
    ]
    got = templates.matches(documents(rows), bench).collect()
    found = {(r["doc_id"], r["item_id"]): r["changed"] for r in got}
    assert found == {(10, 1): 0, (11, 2): 0, (12, 1): 0, (12, 2): 0, (15, 3): 0}


def test_names_that_begin_sentences(spark, documents):
    item = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have now?"
    other = item.replace("Tom", "Bob").replace("3", "4").replace("5", "6")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [
        (10, other),
        (11, f"Here is a riddle.\n{other} Think about it."),
        (12, other.replace("Bob buys", "Ann buys")),
        (13, item),
        (14, "The man has 3 apples. The man buys 5 more. Where is the man with the apples now?"),
    ]
    got = {r["doc_id"]: r["contaminated"] for r in templates.decontaminate(documents(rows), bench).collect()}
    assert got == {10: True, 11: True, 12: False, 13: True, 14: False}


def test_sql_on_planted_items(spark, documents, tmp_path):
    import duckdb

    from oddledger.llm.queries import SQL, op5_templates
    from tests.oracle import compare

    tom = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have now?"
    many = "Did Anna Smith meet Paul Jones in Rome on 12 May 1999?"
    bench = [*BENCH[:3], *BENCH[5:], (7, tom), (8, many), (9, "Who wrote Hamlet in 1603?")]
    texts = [t for _, t in bench] + [CHANGED, tom.replace("Tom", "Bob").replace("3", "4"), f"x {many} y", "Tom", None, ""]
    texts += [f"Some words before. {t} Some more after it." for t in texts if t]
    texts += [tom.replace("Tom buys", "Ann buys"), many.replace("Rome", "Bonn"), "Who wrote Faust in 1808?"]
    documents([(i, t) for i, t in enumerate(texts)] + [(None, tom), (3, many)]).coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ok, message = compare(spark, con, "op5", op5_templates, SQL["op5_templates"], str(tmp_path))
    assert ok, message
    flagged = [r["doc_id"] for r in op5_templates(spark, str(tmp_path)).filter("contaminated").collect()]
    assert len(flagged) > len(texts) / 2


def test_clean_with_any_column_names(spark, documents):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = documents([(1, ITEM), (2, "plain text")]).selectExpr(
        "*", "1 as mark", "2 as own", "3 as id", "4 as row", "5 as _d", "6 as words"
    )
    kept = templates.clean(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
