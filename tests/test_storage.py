"""Files, tables and streams."""

import pytest
from pyspark.sql import functions as F

from test_conversation import random_log, tables
from waymark.operators import conversation as C
from waymark.session import shared_base, work_dir
from waymark.sources import readers, writers
from waymark.streaming import feedback, ingest

SCHEMA = "id int, text string, flag boolean"


def test_csv_round_trip_with_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a": "u\'x\'", "b": "1,2"}', True), (2, None, None)], SCHEMA)
    writers.write_report_csv(rows, f"{tmp_path}/c")
    assert sorted(readers.read_csv(spark, f"{tmp_path}/c", rows.schema).collect()) == sorted(rows.collect())


def test_csv_malformed_row_ends_the_load(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,text,flag\n1,x,true\nnot a number,y,false\n")
    schema = spark.createDataFrame([], SCHEMA).schema
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(tmp_path), schema).collect()
    for asked in (lambda df: df.count(), lambda df: df.select("text").collect()):
        with pytest.raises(Exception, match="(?i)malformed"):
            asked(readers.read_csv(spark, str(tmp_path), schema))
    assert readers.read_csv(spark, str(tmp_path), schema, "DROPMALFORMED").count() == 1


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["  lead and trail  ", "", None, 'a "quoted", cell', "two\nlines", " ", ","]
    rows = spark.createDataFrame([(n, text, None) for n, text in enumerate(texts)], SCHEMA)
    writers.write_report_csv(rows, f"{tmp_path}/c")
    back = readers.read_csv(spark, f"{tmp_path}/c", rows.schema, multi_line=True)
    assert sorted(back.collect()) == sorted(rows.collect())


def test_failed_refresh_leaves_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, v string")
    writers.replace_table(rows, f"{tmp_path}/t")
    broken = rows.select("id", F.raise_error(F.lit("no")).cast("string").alias("v"))
    with pytest.raises(Exception, match="no"):
        writers.replace_table(broken, f"{tmp_path}/t")
    assert [tuple(r) for r in writers.read_table(spark, f"{tmp_path}/t").collect()] == [(1, "a")]
    # a table may be replaced by what was read from it
    writers.replace_table(writers.read_table(spark, f"{tmp_path}/t").union(rows), f"{tmp_path}/t")
    assert writers.read_table(spark, f"{tmp_path}/t").count() == 2


def test_json_normalize(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": {"c": "x", "d": {"e": true}}}\n{"a": 2, "b": {"c": null}}\n')
    raw = readers.read_raw_json(spark, str(tmp_path))
    assert raw.columns == ["raw"]
    flat = readers.normalize_json(raw, readers.infer_variant_schema(raw))
    assert sorted(flat.columns) == ["a", "b.c", "b.d.e"]
    assert sorted(tuple(r) for r in flat.select("a", "`b.c`", "`b.d.e`").collect()) == [(1, "x", True), (2, None, None)]
    given = readers.normalize_json(raw, "a long, b struct<c: string>")
    assert given.columns == ["a", "b.c"]


def test_list_files(spark, small):
    files = readers.list_files(spark, small, "*.parquet").collect()
    assert len(files) == 14 and all(f["bytes"] > 0 for f in files)


def test_replace_append_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for write, count in ((writers.replace_table, 2), (writers.append_table, 4)):
        path = f"{tmp_path}/{write.__name__}"
        write(rows, path)
        write(rows, path)
        assert writers.read_table(spark, path).count() == count
    changes = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(tuple(r) for r in writers.upsert(rows, changes, "id").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in writers.upsert(rows, changes, "id", insert=False).collect()) == [(1, "a"), (2, "b")]


def test_kb_files_are_split(spark, tmp_path):
    writers.write_kb(spark.range(10).coalesce(1), f"{tmp_path}/kb", file_rows=4)
    assert readers.list_files(spark, f"{tmp_path}/kb/versions", "*.parquet").count() == 3


def test_shared_folder_follows_the_session(spark, monkeypatch):
    if spark.conf.get("spark.checkpoint.dir", None):
        assert work_dir(spark, "x").startswith(shared_base(spark) + "/waymark/x-")
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_file_stream_lands_each_file_once(spark, tmp_path):
    source, table, mark = (f"{tmp_path}/{n}" for n in ("in", "table", "mark"))
    rows = spark.createDataFrame([(1, "a", True)], SCHEMA)
    for number in (1, 2):
        rows.withColumn("id", F.lit(number)).write.mode("append").json(source)
        for _ in range(2):  # the second run finds nothing new
            ingest.land(ingest.file_stream(spark, source, rows.schema, "json"), table, mark)
        assert writers.read_table(spark, table).count() == number


def streamed(spark, folder, messages, found, business, bounds):
    """One file per range of turns, each taken before the next arrives."""
    source = f"{folder}/in"
    for low, high in bounds:
        messages.filter((F.col("turn") >= low) & (F.col("turn") < high)).coalesce(1).write.mode("append").parquet(source)
        running = feedback.Feedback(spark, f"{folder}/feedback", found, business)
        feedback.follow(ingest.file_stream(spark, source, messages.schema, "parquet"), running)
    return running


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


REACTION = ("conv_id", "turn", "feedback", "business_id")
SETS = ("user_id", "liked", "disliked")


@pytest.fixture(scope="module")
def log(spark):
    messages, found = tables(spark, *random_log(9, 12))
    tags = F.concat_ws(", ", F.lit("Food"), F.col("business_id"), F.substring("business_id", -1, 1))
    return messages, found, found.select("business_id").distinct().withColumn("categories", tags)


def test_streamed_feedback_equals_the_batch(spark, tmp_path, monkeypatch, log):
    messages, found, business = log
    monkeypatch.setattr(feedback, "WHOLE_EVERY", 2)  # a table of all keys is written on the way
    running = streamed(spark, tmp_path, messages, found, business, ((0, 15), (15, 30), (30, 45), (45, 60), (60, 10**9)))
    want = C.last_item(C.cursor(messages, found), found)
    assert rows_of(running.reactions(), *REACTION) == rows_of(want, *REACTION)
    sets = C.category_sets(C.category_feedback(want, business))
    assert rows_of(running.preferences(), *SETS) == rows_of(sets, *SETS)


def test_a_repeated_batch_changes_nothing(spark, tmp_path, log):
    messages, found, business = log
    running = feedback.Feedback(spark, str(tmp_path), found, business)
    parts = [messages.filter("turn < 20"), messages.filter("turn >= 20 and turn < 50"), messages.filter("turn >= 50")]
    for number, part in enumerate(parts):
        running.take(part, number)
    before = rows_of(running.reactions(), *REACTION), rows_of(running.preferences(), *SETS)
    standing = sorted(map(tuple, running.standing.before(3).collect()))
    running.take(parts[2], 2)
    assert (rows_of(running.reactions(), *REACTION), rows_of(running.preferences(), *SETS)) == before
    assert sorted(map(tuple, running.standing.before(3).collect())) == standing
    # Nothing arrives: nobody's rows change.
    running.take(messages.limit(0), 3)
    assert (rows_of(running.reactions(), *REACTION), rows_of(running.preferences(), *SETS)) == before


def test_a_streamed_conversation_is_spread_over_stretches(spark, tmp_path, log):
    messages, found, business = log
    running = feedback.Feedback(spark, str(tmp_path), found, business)
    moves = C.cursor(messages, found, running.standing.before(0))
    text = moves._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in text and "Python" not in text and "InPandas" not in text


def test_latest_rows_read_only_earlier_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feedback, "WHOLE_EVERY", 3)
    table = feedback.LatestRows(spark, str(tmp_path), "k", "k string, v long")
    for number in range(7):
        table.write(number, spark.createDataFrame([("a", number), (f"b{number}", number)], "k string, v long"))
    found = dict(tuple(r) for r in table.before(5).collect())
    assert found == {"a": 4, **{f"b{n}": n for n in range(5)}}
    assert table.before(0).count() == 0 and table.before(7).count() == 8
    assert feedback.LatestRows(spark, str(tmp_path), "k", "k string, v long").before(7).count() == 8


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    """Read with line breaks in cells, a file is one task's: no file holds all rows of a task that wrote."""
    rows = spark.range(0, 250, 1, 1).selectExpr("id", "concat('a', chr(10), id) AS text")
    writers.write_report_csv(rows, f"{tmp_path}/c", 100)
    back = readers.read_csv(spark, f"{tmp_path}/c", rows.schema, multi_line=True)
    per_file = back.groupBy("_metadata.file_path").count().toPandas()["count"]
    assert sorted(per_file) == [50, 100, 100] and sorted(back.collect()) == sorted(rows.collect())
