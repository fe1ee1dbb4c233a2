"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, chat, decontaminate, fertility, html_text, langid, maxent_lm, ngram_join, packing
from . import ranked_search, repeats, secret_scan, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_measures(_table(spark, sf_dir, "documents"))


@_query
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.id_fold(3) == F.lit(1)
    return langid.predict(docs, langid.train(docs, ~held_out), held_out)


@_query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spelled = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", spelled), (-7, 1, "assistant", spelled)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(chats.unionByName(extra)))


@_query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents")).drop("found")


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


_SPACE = "[\\x09-\\x0D\\x20]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda x: x <> '')"


ORACLES["op2_ngram_jaccard"] = (
    f"with recursive w as (select doc_id, {_words(_LOWERED)} as words from documents), "
    "p as (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0), "
    "s as materialized (select distinct doc_id, md5(array_to_string(words[i:i + 4], ' ')) as h from p), "
    "n as materialized (select doc_id, count(*) as n from s group by doc_id), "
    "o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by all), "
    "e as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)), "
    "u as materialized (select a, b from e union select b, a from e), "
    "r(doc_id, seen) as (select doc_id, doc_id from n union select r.doc_id, u.b from r join u on u.a = r.seen) "
    "select w.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, coalesce(min(r.seen), w.doc_id) as component_id "
    "from w left join n using (doc_id) left join r using (doc_id) group by w.doc_id"
)

ORACLES["op3_substring_dedup"] = (
    f"with w as materialized (select doc_id, {_words("coalesce(text, '')")} as words from documents), "
    "p as (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w), "
    "g as materialized (select doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) as h from p), "
    "again as (select doc_id, i from g where h in (select h from g group by h having count(*) > 1)), "
    "gone as materialized (select distinct doc_id, i + j as i from again, range(0, 35) t(j)), "
    "kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from (select doc_id, unnest(words) as word, "
    "unnest(range(1, len(words) + 1)) as i from w) anti join gone using (doc_id, i) group by doc_id) "
    "select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(kept.n, 0) as bigint) as n_removed, "
    "sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)"
)


@_query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(_table(spark, sf_dir, "documents"))


@_query
def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(_table(spark, sf_dir, "documents"), langid.id_fold(7) == F.lit(2))


@_query
def op11_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"), with_ids=False)


_TERMS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES["op11_best_position_search"] = (
    f"with d as materialized (select row_number() over () as r, doc_id, {_TERMS} as t from documents), "
    "n as (select r, doc_id, len(t) as n from d where len(t) > 0), "
    "g as materialized (select count(*) as docs, cast(sum(n) as bigint) as terms from n), "
    f"i as materialized (select item_id, t, count(*) as c from (select item_id, unnest({_TERMS}) as t from benchmark) group by all), "
    "p as materialized (select r, t, count(*) as tf from (select r, unnest(t) as t from d) semi join i using (t) group by all), "
    "w as (select t, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, g group by t, docs), "
    "e as (select r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) as e "
    "from p join n using (r) join w using (t), g), "
    "s as (select item_id, r, sum(c * e) as score from i join e using (t) group by all) "
    "select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, "
    "cast(score as bigint) as score from s join n using (r) where score > 0 "
    "qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"
)
