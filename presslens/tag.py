"""Tag the people that articles mention, from the command line: python -m presslens.tag --people people.csv --articles in.csv --output out.csv"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens import schema
from presslens.plans import gazetteer, mentions
from presslens.session import session, ship
from presslens.sources import files


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV or JSON, told by the suffix; the column names in lower case."""
    read = {".tsv": files.read_tsv, ".json": files.read_json}.get(path[path.rfind(".") :].lower(), files.read_csv)
    return schema.lower_names(read(spark, path))


def tag_articles(spark: SparkSession, people: str, articles: DataFrame, text: str | None = None, mode: str = "coref") -> DataFrame:
    """articles with tagged_text. people is the path of a gazetteer with name_final or name, and maybe aliases (parted by ;) and tag."""
    p = read_any(spark, people)
    name = schema.text_column(p, ["name_final", "name"])
    rows = gazetteer.aliases(p, name, *[c if c in p.columns else None for c in ("aliases", "tag")])
    named = [text.lower(), *schema.TEXT_NAMES] if text else None
    return mentions.tag(articles, gazetteer.name_table(rows), gazetteer.gated_words(rows), text=schema.text_column(articles, named), mode=mode)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--people", required=True, help="the gazetteer: CSV, TSV or JSON")
    a.add_argument("--text-column", help="the column with the text; if it isn't there, or isn't given, the first of the usual names")
    a.add_argument("--mode", choices=["coref", "ner", "all"], default="coref")
    a.add_argument("--articles", help="one table of articles")
    a.add_argument("--output", help="where its tagged copy goes: JSON if the name says so, else CSV")
    a.add_argument("--topic-dir", help="a folder of one CSV for each topic")
    a.add_argument("--output-dir", help="a folder for the tagged copies, named alike")
    x = a.parse_args(argv)
    if bool(x.topic_dir) == bool(x.articles):
        a.error("give either --articles or --topic-dir")
    if (x.topic_dir and not x.output_dir) or (x.articles and not x.output):
        a.error("say where the result goes: --output for --articles, --output-dir for --topic-dir")
    spark = spark or session()
    ship(spark)
    if x.articles:
        files.write_by_suffix(tag_articles(spark, x.people, read_any(spark, x.articles), x.text_column, x.mode), x.output)
    else:
        found = schema.lower_names(files.read_topics(spark, x.topic_dir))
        files.write_topic_files(tag_articles(spark, x.people, found, x.text_column, x.mode), x.output_dir)


if __name__ == "__main__":
    main()
