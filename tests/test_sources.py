import json

from pyspark.sql import functions as F

from termloom.sources import readers, writers
from termloom.streaming import terms


def test_readers(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps([{"id": "1", "text": "a"}, {"id": "2", "text": None}]))
    assert readers.requirements_json(spark, str(p)).count() == 2
    p = tmp_path / "l.txt"
    p.write_text("one\r\ntwo\n\nlast", encoding="utf-8")
    assert [r.line for r in readers.lines(spark, str(p)).collect()] == ["one", "two", "last"]
    p = tmp_path / "c.csv"
    p.write_text('x,"y"\na,"b, c"\nd,\n')
    assert sorted(tuple(r) for r in readers.clusters_csv(spark, str(p)).collect()) == [("x", "a"), ("x", "d"), ("y", "b, c")]
    p = tmp_path / "w.csv"
    p.write_bytes("satz;tag;x\nMöhre€;NN;1\n".encode("cp1252"))
    assert tuple(readers.table_csv(spark, str(p), ["satz", "tag"], encoding="windows-1252").first()) == ("Möhre€", "NN")
    p = tmp_path / "d.json"
    p.write_text('{"a": "x", "b": "y"}')
    assert sorted(tuple(r) for r in readers.dictionary_json(spark, str(p)).collect()) == [("a", "x"), ("b", "y")]
    p = tmp_path / "s.json"
    p.write_text('{"w": [3, 0.5]}')
    assert tuple(readers.statistics_json(spark, str(p)).first()) == ("w", 3, 0.5)
    p = tmp_path / "lex.txt"
    p.write_text("Haus\tNN\n")
    assert tuple(readers.tagger_lexicon(spark, str(p)).first()) == ("Haus", "NN")
    df = spark.createDataFrame([("('a', 'b')\n('c d', 'e')\nbad",)], "x string")
    assert [tuple(r) for r in readers.pairs_from_text(df, "x").collect()] == [("a", "b"), ("c d", "e")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("t", [1, 2], None)], "term string, ids array<int>, c string")
    writers.table_tsv(df, str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), sep="\t", header=True).first()["ids"] == "1; 2"
    assert json.loads(writers.as_json(df).first()[0]) == {"term": "t", "ids": [1, 2]}
    lines = spark.createDataFrame([(5, "x"), (2, "y")], "n int, text string")
    assert sorted(tuple(r) for r in writers.lines_to_json(lines, "n", "text").collect()) == [("1", "y"), ("2", "x")]
    log = writers.run_log(spark.createDataFrame([(1, "der Nutzer")], "req_no int, text string"), "d", False).first()
    assert (log["dataset"], log["corpus_lang"]) == ("d", "DE")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("eins zwei",), ("eins",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = terms.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("term_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("term_counts").collect()) == [("eins", 2), ("zwei", 1)]
    events = spark.createDataFrame([(1, "a"), (2, "a"), (90000, "b")], "s long, k string").select(F.timestamp_seconds("s").alias("ts"), "k")
    events.write.parquet(str(tmp_path / "ev"))
    s = terms.windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "ev")), "ts", "k")
    q = s.writeStream.outputMode("append").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.k, r.n) for r in spark.table("windowed").collect()] == [("a", 2)]
