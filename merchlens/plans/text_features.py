"""Text statistics, keyword, unit and language features, and the flagship report."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import KEYWORDS, STOPWORDS_EN, STOPWORDS_FR, UNIT_PATTERNS
from ..functions.cleaning import FINAL_FLAGS, clean_frame
from ..functions.ngrams import char_ngrams
from ..functions.text_merge import raw_text
from ..functions.text_stats import (
    add_text_features,
    char_length,
    digit_count,
    extract_text_features,
    feature_names,
    keyword_counts,
    language_flags,
    language_vote_flags,
    punctuation_count,
    text_lengths,
    token_frequencies,
    unit_flags,
    weight_features,
    word_length,
)
from ..operators.splits import stratified_flag
from ..operators.summaries import describe_features, feature_summary
from ..session import persist_to_table
from . import sqltext as S
from .registry import query
from .standins import MEASURE_TEXTS, PRODUCTS, measure_texts, products, table

COLUMNS = ["designation", "description"]
_UPPER, _DIGIT, _PUNCT = r"\P{Lu}+", r"\P{Nd}+", f"[{S.LETTER}{S.WS}]+"


def sql_features(c: str) -> dict[str, str]:
    x = f"coalesce({c}, '')"
    ratio = lambda n: f"CASE WHEN length({x}) = 0 THEN 0.0::DOUBLE ELSE {n} / length({x}) END"
    return {
        f"{c}_len_char": f"length({x})",
        f"{c}_len_words": S.words(c),
        f"{c}_num_digits": S.keep_only(c, _DIGIT),
        f"{c}_num_punctuation": S.keep_only(c, _PUNCT),
        f"{c}_uppercase_ratio": ratio(S.keep_only(c, _UPPER)),
        f"{c}_digit_ratio": ratio(S.keep_only(c, _DIGIT)),
    }


_FEATURES = {k: v for c in COLUMNS for k, v in sql_features(c).items()}
FEATURES = "features AS (SELECT idx, " + ", ".join(f"{v} AS {k}" for k, v in _FEATURES.items()) + " FROM products)"


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" if n.endswith("ratio") else n for n in names)


@query("text_features", f"WITH {PRODUCTS}, {FEATURES} SELECT idx, {_rounded(list(_FEATURES))} FROM features", ints=[n for n in _FEATURES if not n.endswith("ratio")])
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract_text_features(products(spark, sf), COLUMNS, ["idx"])
    return rows.withColumns({n: F.round(n, 6) for n in rows.columns if n.endswith("ratio")})


@query(
    "text_lengths",
    f"""WITH {PRODUCTS} SELECT idx, length(designation) AS char_designation, length(coalesce(description, '')) AS char_description,
    {S.words("designation")} AS word_designation, {S.words("description")} AS word_description FROM products""",
    ints=[f"{u}_{c}" for u in ("char", "word") for c in COLUMNS],
)
def lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).select("idx", *COLUMNS)
    rows = text_lengths(text_lengths(rows, COLUMNS, "char", "char"), COLUMNS, "word", "word")
    return rows.drop(*COLUMNS)


_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count({n}) AS count, round(avg({n}), 6) AS mean, round(stddev_samp({n}), 6) AS std, "
    f"round(min({n})::DOUBLE, 6) AS min, round(quantile_cont({n}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({n}::DOUBLE, 0.5), 6) AS median, "
    f"round(quantile_cont({n}::DOUBLE, 0.75), 6) AS q75, round(max({n})::DOUBLE, 6) AS max FROM features"
    for n in _FEATURES
)


@query("feature_description", f"WITH {PRODUCTS}, {FEATURES} {_DESCRIBE}")
def feature_description(spark: SparkSession, sf: str) -> DataFrame:
    # three passes read the features, the texts are read once
    rows = persist_to_table(extract_text_features(products(spark, sf), COLUMNS, ["idx"]), "text-features")
    out = describe_features(rows, feature_names(COLUMNS))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("feature", "count")})


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}_len_char), 6) AS mean_chars, round(avg({c}_len_words), 6) AS mean_words,
    round(avg({c}_num_digits), 6) AS mean_digits, round(avg({c}_num_punctuation), 6) AS mean_punctuation,
    round(avg({c}_uppercase_ratio) * 100, 6) AS uppercase_pct, round(avg({c}_digit_ratio) * 100, 6) AS digit_pct FROM features"""
    for c in COLUMNS
)


@query("feature_means", f"WITH {PRODUCTS}, {FEATURES} {_SUMMARY}")
def feature_means(spark: SparkSession, sf: str) -> DataFrame:
    out = feature_summary(add_text_features(products(spark, sf), COLUMNS), COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "column"})


TOKENS = {"<li>": "n_li", "<p>": "n_p", "[aeiou]": "n_vowel_class", "&amp;": "n_amp"}


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {S.quoted(pattern)}))"


@query(
    "token_frequencies",
    "SELECT page_id, " + ", ".join(f"{_count('x', t)} AS {n}" for t, n in TOKENS.items()) + ", "
    + ", ".join(f"round({_count('x', t)} / length(x), 6) AS {n}_rate" for t, n in TOKENS.items())
    + " FROM (SELECT page_id, ' ' || url || ' ' || html AS x FROM pages)",
    ints=TOKENS.values(),
)
def frequencies(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    rows = token_frequencies(pages, list(TOKENS), ["url", "html"])
    rows = token_frequencies(rows, list(TOKENS), ["url", "html"], normalize=True, name_prefix="rate")
    counts = [F.col(f"`{t}`").alias(n) for t, n in TOKENS.items()]
    rates = [F.round(F.col(f"`rate_{t}`"), 6).alias(f"{n}_rate") for t, n in TOKENS.items()]
    return rows.select("page_id", *counts, *rates)


@query(
    "keyword_features",
    "SELECT doc_id, " + ", ".join(f'{_count("text", "|".join(w))} AS "{c}_keywords"' for c, w in KEYWORDS.items()) + " FROM documents",
    ints=[f"{c}_keywords" for c in KEYWORDS],
)
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    counts = keyword_counts(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in counts.items()])


_ANY_UNIT = S.quoted("(?i)" + "|".join(f"(?:{p})" for p in UNIT_PATTERNS.values()))


@query(
    "unit_features",
    f"""WITH {MEASURE_TEXTS} SELECT idx, {S.keep_only("text", "[^0-9]+")} AS nb_digits_text,
    regexp_matches(text, 'n° ?[0-9]')::INT AS contains_numerotation, regexp_matches(text, {_ANY_UNIT})::INT AS has_any_unit,
    regexp_matches(designation, {_ANY_UNIT})::INT AS title_has_unit FROM measured""",
    ints=["nb_digits_text"],
)
def units(spark: SparkSession, sf: str) -> DataFrame:
    title = unit_flags(F.col("designation"))["has_any_unit"].alias("title_has_unit")
    return measure_texts(spark, sf).select("idx", *[c.alias(n) for n, c in unit_flags(F.col("text")).items()], title)


def _votes(words: set[str]) -> str:
    listed = ", ".join(S.quoted(w) for w in sorted(words))
    return f"len(list_filter(string_split_regex(lower(t), '[^\\p{{L}}'']+'), lambda w: w IN ({listed})))"


_FR, _EN = set(STOPWORDS_FR) - set(STOPWORDS_EN), set(STOPWORDS_EN) - set(STOPWORDS_FR)


@query(
    "language_vote_flags",
    f"""WITH {PRODUCTS}, v AS (SELECT idx, lang, {_votes(_FR)} AS fr, {_votes(_EN)} AS en FROM (
      SELECT idx, lang, designation || ' ' || coalesce(description, '') AS t FROM products))
    SELECT idx, lang, (fr > en)::INT AS txt_fr, (en > fr)::INT AS txt_en, (en = fr)::INT AS txt_other FROM v""",
)
def language_votes(spark: SparkSession, sf: str) -> DataFrame:
    return language_vote_flags(products(spark, sf)).select("idx", "lang", "txt_fr", "txt_en", "txt_other")


def language_model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Character trigram naive Bayes trained on 70 % of the documents, applied to all of them."""
    text = raw_text(F.col("designation"), F.col("description"))
    rows = stratified_flag(products(spark, sf).withColumn("text", text), "lang", "idx", 0.7, out="is_train")
    rows = rows.withColumn("grams", char_ngrams(F.col("text"), 3, 3, lowercase=True))
    stages = [
        StringIndexer(inputCol="lang", outputCol="y", stringOrderType="alphabetAsc"),
        HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << 16),
        NaiveBayes(labelCol="y", featuresCol="features"),
    ]
    model = Pipeline(stages=stages).fit(rows.filter("is_train"))
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    return model.transform(rows).withColumn("detected", F.get(names, F.col("prediction").cast("int")))


@query("language_model_flags")
def language_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = language_model_rows(spark, sf)
    return rows.withColumns(language_flags(F.col("detected"))).select(
        "idx", "lang", "is_train", "detected", "txt_fr", "txt_en", "txt_other"
    )


@query(
    "feature_weighting",
    """SELECT vec_id AS idx, round(embedding[1]::DOUBLE * 1.2, 6) AS first, round(embedding[64]::DOUBLE * 1.2, 6) AS last,
    round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 1.2)), 6) AS total FROM embeddings""",
)
def feature_weighting(spark: SparkSession, sf: str) -> DataFrame:
    weighted = weight_features(F.col("embedding").cast("array<double>"), 1.2)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), weighted.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "idx", F.round(F.element_at("w", 1), 6).alias("first"), F.round(F.element_at("w", -1), 6).alias("last"),
        F.round(total, 6).alias("total"),
    )


# --- flagship: cleaned products, their statistics and shares per language ------------------------
_CLEAN_CHARS = "string_split(lower(regexp_replace(nfc_normalize(raw), '<[^>]+>', ' ', 'g')), '')"
_DESCRIPTION = "coalesce(description, '')"
RAW_TEXT = S.strip(f"{S.strip('designation')} || ' ' || {S.strip(_DESCRIPTION)}")


@query(
    "catalog_language_report",
    f"""WITH {PRODUCTS}, raws AS (SELECT lang, {RAW_TEXT} AS raw FROM products),
    chars AS (SELECT lang, {_CLEAN_CHARS} AS chars FROM raws),
    clean AS (SELECT lang, {S.collapse(S.lone_marks(S.dots_list("chars")))} AS t FROM chars)
    SELECT lang, count(*) AS products, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage,
           round(avg(length(t)), 6) AS mean_chars, round(avg({S.words("t")}), 6) AS mean_words,
           round(avg({S.keep_only("t", _DIGIT)}), 6) AS mean_digits, round(avg({S.keep_only("t", _PUNCT)}), 6) AS mean_punctuation
    FROM clean GROUP BY lang""",
)
def catalog_language_report(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    text = raw_text(F.col("designation"), F.col("description"))
    clean = clean_frame(products(spark, sf).select("lang", "designation", "description"), {"t": text}, **FINAL_FLAGS)
    stats = clean.groupBy("lang").agg(
        F.count(F.lit(1)).alias("products"),
        F.round(F.avg(char_length(t)), 6).alias("mean_chars"),
        F.round(F.avg(word_length(t)), 6).alias("mean_words"),
        F.round(F.avg(digit_count(t)), 6).alias("mean_digits"),
        F.round(F.avg(punctuation_count(t)), 6).alias("mean_punctuation"),
    )
    share = F.bround(F.col("products") * 100.0 / F.sum("products").over(Window.partitionBy()), 2)
    return stats.withColumn("percentage", share)
