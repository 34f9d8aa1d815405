"""The library's relations, and helpers that bring a table into their shape while the plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATIONS = {
    "raw_api_articles": "article_id string, sectionName string, webTitle string, webUrl string, bodyContent string, webPublicationDate string, id string",
    "raw_db_articles": "URL string, `Article Category` string, `Publication Date` string, `Article Author` string, `Article Title` string, `Article Contents` string, `Data Quality` string",
    "articles": "url string, section string, date string, title string, content string, author string, source string",
    "topic_articles": "url string, section string, date string, title string, content string, author string, source string, topic_id int, topic_name string",
    "gazetteer": "id long, name_final string, name_api_display string, name_api_full_title string, name_normalized string, name_resolved string, resolution_method string, party string, gender string, constituency string, membership_start date, membership_end date",
    "mp_sentences": "sentence string, mp string, gender string, topic string, date string, url string",
    "snippets": "person string, article_index int, snippet_index int, snippet string, gender string",
    "causal_edges": "person string, article_index int, snippet_index int, relation string, cause string, effect string, confidence double, evidence string, sent_id int",
    "captures": "timestamp string, original string, statuscode string, mimetype string, digest string, length string",
    "ann_sentence": "doc_id long, sent_id int, text string, char_start int, char_end int",
    "ann_token": "doc_id long, tok_i int, sent_id int, text string, lower string, lemma string, pos string, dep string, head_i int, char_start int, char_end int",
    "ann_entity": "doc_id long, start int, end int, text string, label string",
    "ann_chunk": "doc_id long, start int, end int, text string, root_i int, root_dep string, root_pos string, head_lemma string",
    "ann_coref": "doc_id long, cluster_id int, mention_id int, start int, end int, text string, sent_id int, root_dep string, root_lemma string, head_lemma string",
    "verb_lexicon": "verb string, agent double, theme double",
}
#: How the two article sources name the columns of ``articles``.
API_NAMES = {"webUrl": "url", "sectionName": "section", "webPublicationDate": "date", "webTitle": "title", "bodyContent": "content"}
DB_NAMES = {"URL": "url", "Article Category": "section", "Publication Date": "date", "Article Author": "author", "Article Title": "title", "Article Contents": "content", "Data Quality": "quality"}
ARTICLE = ["url", "section", "date", "title", "content", "author", "source"]
TEXT_NAMES = ["text", "content", "body", "article", "article_text", "bodycontent", "snippet", "sentence"]


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def sniff_rename(df: DataFrame) -> DataFrame:
    """The names of ``articles`` for a table of either source, told by its columns."""
    return rename(df, API_NAMES if {"webUrl", "webPublicationDate"} & set(df.columns) else DB_NAMES)


def align(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """Exactly these columns in this order; missing ones are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def text_column(df: DataFrame, names: list[str] | None = None) -> str:
    """The first of the names that the table has, whatever their case."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    for n in names or TEXT_NAMES:
        if n.lower() in by_lower:
            return by_lower[n.lower()]
    raise ValueError(f"no text column among {df.columns}")


def map_values(df: DataFrame, key: str, pairs: DataFrame, pair_key: str, pair_value: str, out: str, default: str) -> DataFrame:
    """df with out = the value that pairs has for the key, or the default. Equal keys count once, the last value by order wins."""
    one = pairs.groupBy(F.col(pair_key).alias("_k")).agg(F.max(pair_value).alias(out))
    return df.join(one, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(out, F.coalesce(out, F.lit(default)))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns named with their path."""
    out = []

    def walk(path: list[str], kind) -> None:
        for f in kind.fields:
            here = [*path, f.name]
            if hasattr(f.dataType, "fields"):
                walk(here, f.dataType)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))

    walk([], df.schema)
    return df.select(*out)
