from pyspark.sql import functions as F

from tickloom.llm import decontaminate as D

ITEMS = [
    (1, "In the garden near Anna there are 12 red apples and 7 green pears, so Anna counts 12 apples again before 7 pears go to the market."),
    (2, "all words of this plain question are written without any number or name at all"),
    (3, "too short"),
    (4, None),
    (5, "What is 3 plus 4 apples?"),
    (6, "Who wrote this long famous book?"),
    (7, "1 2 3 4 5 6 7 8 9 10"),
]
FILL = "some ordinary opening words stand here and go on for a while. "
DOCS = [
    (10, FILL + ITEMS[0][1] + " " + FILL),
    (11, FILL + ITEMS[0][1].replace("12", "40").replace("7", "95").replace("Anna", "Mary Jane") + FILL),
    (12, FILL + "In the garden near Anna there are 12 red apples and 7 green pears, so Paul counts 15 apples again before 3 pears go to the market."),
    (13, FILL + ITEMS[1][1].upper()),
    (14, FILL * 30),
    (15, None),
    (16, ""),
    (17, "too short"),
    (18, "all words of this plain question are not here"),
    (10, FILL + ITEMS[0][1] + " " + FILL),
    (None, ITEMS[1][1]),
    (19, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
    (20, "9 1 2 3 4 5 6 7 8 9 11 12"),
    (21, FILL + "What is 5 plus 6 apples? And user34, what is 3 plus 4 apples? What is 7 plus 8 apples?"),
    (22, "What is 5 plus 6 apples? What is 3 plus 4 pears?"),
    (23, FILL + "who wrote this long, famous book"),
    (24, "Who wrote this long book?"),
    (25, FILL + "Xy34 on the 3rd. " + ITEMS[0][1]),
    (26, "so " + "Ab Cd " * 8000 + "1.2" * 30000 + FILL + ITEMS[1][1]),
]


def test_finds_verbatim_and_reparameterised_questions(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"h": F.lit("clash"), "item_id": F.lit(0), "w": F.lit(1)})
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_item", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (None, 2), (19, 7), (21, 5), (23, 6), (25, 1), (26, 2)}
    assert got[21, 5].same_values and got[21, 5].n_slots == 2 and got[25, 1].same_values
    assert got[10, 1].same_values and not got[11, 1].same_values and got[11, 1].n_slots == 3
    shuffled = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench, D.TemplateRules(small=0)).collect()}
    assert shuffled == set(got)
    kept = D.without_benchmark(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [12, 14, 15, 16, 17, 18, 20, 22, 24]
    assert D.contaminated(docs.limit(0), bench).collect() == [] and D.contaminated(docs, bench.limit(0)).collect() == []


def test_values_behind_numbers_glued_to_letters(spark):
    item = "The shop sold 5 apples to the first guest and 7 pears to the next, so of 5 apples and 7 pears 3 were bad and 3 sweet."
    start = "Mail user34@mail7.org came on the 3rd day of covid19 with Anna5 and said this. "
    docs = [(1, item), (2, start + item), (3, start + item.replace("5", "40").replace("7", "x8 9")), (4, start + item.replace("5", "61").replace("7", "12").replace("3", "8"))]
    got = {r.doc_id: r for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {k: (r.n_slots, r.n_consistent, r.same_values) for k, r in got.items() if k != 3} == {1: (3, 3, True), 2: (3, 3, True), 4: (3, 3, False)}


def test_template(spark):
    df = spark.range(1).select(F.lit("He paid 3,50 euros to Jo Ann, then Bob ran 5km in 2024. Then End").alias("t"))
    r = df.select(D.template(F.col("t")).alias("w"), D.slot_values(F.col("t")).alias("v")).first()
    assert r.w == ["he", "paid", "0", "2", "to", "1", "then", "1", "ran", "0", "2", "in", "0", "then", "end"] or r.w[5] == "1"
    assert r.v.numbers == ["3,50", "5", "2024"] and r.v.names[:2] == ["jo ann", "bob"]


def test_sql_gives_the_same(spark, tmp_path):
    import duckdb

    from tickloom.llm import sql

    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    bench.coalesce(1).write.parquet(f"{tmp_path}/b")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/b/*.parquet')")
    out = con.execute(sql.OP2)
    columns = [c[0] for c in out.description]
    rows = lambda rs: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs), key=str)
    assert rows(out.fetchall()) == rows(D.contaminated(docs, bench).select(columns).collect())
