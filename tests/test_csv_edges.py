"""White space at the ends of a field comes back from CSV, whoever writes it."""

from presslens.sources import files

TEXTS = [" lead", "trail ", "\ttab\t", "\nlines\n", "   ", "\r\n", ' "x" ', '" ', "\x01", "a\r\nb", "plain", " x"]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    files.write_csv(df, f"{tmp_path}/a")
    files.write_by_suffix(df, f"{tmp_path}/b.csv")
    files.write_by_suffix(df, f"{tmp_path}/b.json")
    read = [files.read_csv(spark, f"{tmp_path}/a", "i int, t string"), files.read_csv(spark, f"{tmp_path}/b.csv", "i int, t string"), files.read_json_lines(spark, f"{tmp_path}/b.json", "i int, t string")]
    for got in read:
        assert [r.t for r in got.orderBy("i").collect()] == TEXTS


def test_topic_files(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "one topic") for i, t in enumerate(TEXTS)], "i int, t string, topic string")
    files.write_topic_files(df, f"{tmp_path}/topics")
    got = files.read_topics(spark, f"{tmp_path}/topics", "i int, t string").orderBy("i").collect()
    assert [(r.t, r.topic) for r in got] == [(t, "one_topic") for t in TEXTS]
