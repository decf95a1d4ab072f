"""Golden rows of the text rules."""

import re

import pytest
from pyspark.sql import functions as F

from merchlens.functions import cleaning as C
from merchlens.functions.ngrams import char_ngrams, word_ngrams
from merchlens.functions.numeric_tokens import (
    _label, bucket_label, extract_measures, measures_of, replace_measures, strategy_tokens, unit_factor, unit_symbol,
)
from merchlens.functions.text_merge import build_text
from merchlens.functions.text_stats import keyword_counts, text_features, text_lengths, token_frequencies


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "flags, text, want",
    [
        (["merge_dimensions"], "22 x 11 x 2", "22x11x2"),
        (["merge_dimensions"], "180 X 180 et L x H x L", "180x180 et LxHxL"),
        (["merge_units"], "500 g", "500g"),
        (["merge_units"], "100 % x", "100 % x"),
        (["merge_units"], "3000 mAh 32 Go", "3000mAh 32Go"),
        (["merge_durations"], "24 h", "24h"),
        (["merge_durations"], "24h/24 7 j / 7", "24h24 7j7"),
        (["merge_age_ranges"], "3-5 ans", "3_5ans"),
        (["merge_durations", "merge_age_ranges"], "6 ans et plus", "6plus_ans"),
        (["tag_years"], "né en 1917.", "né en year1917 ."),
        (["remove_punctuation"], "Hello. World 3.14 a - b / c ////", "Hello World 3.14 a b c"),
        (["remove_boilerplate"], "li li strong beau et de plus", "beau plus"),
        (["remove_stopwords"], "le chat and the dog", "chat dog"),
        (["remove_single_letters", "remove_single_digits"], "a bc 7 12 é", "bc 12"),
        (["remove_pure_punct_tokens"], "a -- b … c!", "a b c!"),
        (["fix_encoding"], "Ã©tÃ©", "été"),
        (["fix_encoding"], "été Ãxx", "été Ãxx"),
        (["fix_encoding"], "câ€™est “bien” ﬁn", "c'est \"bien\" fin"),
        (["unescape_html"], "caf&eacute; &amp; th&#233; &lt;b&gt;", "café & thé <b>"),
        (["normalize_unicode"], "été", "été"),
        (["remove_html_tags", "lowercase"], "<p>Bon<br/>JOUR</p>", "bon jour"),
        ([], None, ""),
    ],
)
def test_cleaning(spark, flags, text, want):
    assert one(spark, text, lambda c: C.clean_text(c, **dict.fromkeys(flags, True))) == want


def test_frame_and_column_cleaning_agree(spark):
    texts = [("Ã©tÃ© &amp; <b>24 h</b>. Fin",), (None,), ("  a  -  b 1999 ",), ("“x” 3-5 ans 10 x 20",)]
    df = spark.createDataFrame(texts, "x string")
    flags = dict.fromkeys(C.CLEANING_FLAGS, True)
    staged = C.clean_frame(df, {"a": F.col("x")}, **flags).withColumn("b", C.clean_text(F.col("x"), **flags))
    assert all(r["a"] == r["b"] for r in staged.collect())


def test_unknown_flag():
    with pytest.raises(TypeError):
        C._stages({"no_such_step": True})


@pytest.mark.parametrize(
    "mode, text, want",
    [
        ("light", "Aquarium 60 x 30 x 35 cm 54 litres", "Aquarium [volume_moyen] [volume_moyen]"),
        ("light", "Drap 90 x 190 cm", "Drap [surface_moyenne]"),
        ("light", "ruban 5-12 cm", "ruban entre [petite_longueur] et [longueur_moyenne]"),
        ("light", "Jouet 3-5 ans", "Jouet entre [age_enfant] et [age_enfant]"),
        ("light", "Clé 512 mb", "Clé [grande_mémoire]"),
        ("light", "Ampoule 60 W", "Ampoule [power]"),
        ("light", "Batterie 3000 mAh", "Batterie [capacity]"),
        ("light", "poids 500 g et 2,5 kg net", "poids [poids_leger] et [poids_moyen] net"),
        ("light", "5 mètres de 20 m²", "[très_grande_longueur] de [grande_surface]"),
        ("full", "20 euros", "[prix_moyen]"),
        ("full", "3.5", "[petit_nombre].[nombre_moyen]"),
        ("full", "n° 12 du 03/04/1999", "[petit_numero] du [date_contemporaine]"),
        ("phys", "Ampoule 60 W 10 cm", "Ampoule 60 W [longueur_moyenne]"),
        (["age"], "3 ans 10 cm", "[age_enfant] 10 cm"),
        ("full", "", ""),
        ("full", "marks ﷐ ﷑ ﷒ stay 7 cm", "marks ﷐ ﷑ ﷒ stay [petite_longueur]"),
    ],
)
def test_numeric_tokens(spark, mode, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert replace_measures(df, ["x"], mode).first()["x"] == want


def test_measures_of_one_text(spark):
    df = spark.createDataFrame([(1, "60 x 30 x 35 cm, 5-12 cm, 60 W")], "id int, x string")
    rows = {(r["measure"], r["base_value"], r["label"]) for r in extract_measures(df, "x", ["id"]).collect()}
    assert rows == {
        ("volume", 63000.0, "volume moyen"),
        ("length", 5.0, "petite longueur"),
        ("length", 12.0, "longueur moyenne"),
        ("power", 60.0, "power"),
    }


def test_light_tokens_are_full_tokens():
    assert set(strategy_tokens("light")) < set(strategy_tokens("full"))


def test_ngrams(spark):
    assert one(spark, "le petit chat", lambda c: word_ngrams(c, 1, 3)) == [
        "le", "petit", "chat", "le petit", "petit chat", "le petit chat",
    ]
    assert one(spark, "a", lambda c: word_ngrams(c, 1, 2)) == []
    assert one(spark, "ab  😀c", lambda c: char_ngrams(c, 3, 4)) == ["ab ", "b 😀", " 😀c", "ab 😀", "b 😀c"]
    assert one(spark, "ab", lambda c: char_ngrams(c, 3, 5)) == []


def test_text_features_of_empty_and_accented_text(spark):
    df = spark.createDataFrame([(None,), ("Été 2, où ?",)], "x string").select(
        *[c.alias(n) for n, c in text_features(["x"]).items()]
    )
    empty, full = df.collect()
    assert list(empty) == [0, 0, 0, 0, 0.0, 0.0]
    assert (full["x_len_char"], full["x_len_words"], full["x_num_digits"], full["x_num_punctuation"]) == (11, 4, 1, 2)
    assert full["x_uppercase_ratio"] == pytest.approx(1 / 11)


def test_tokens_are_patterns_unless_literal(spark):
    df = spark.createDataFrame([("[abc] cab", None)], "a string, b string")
    assert token_frequencies(df, ["[abc]"]).first()["[abc]"] == 6
    assert token_frequencies(df, ["[abc]"], literal=True).first()["[abc]"] == 1


def test_keywords_do_not_overlap(spark):
    counts = keyword_counts(F.col("x"), {"k": ["jeu", "jeux"], "r": ["a.c"]})
    row = spark.createDataFrame([("jeux jeu abc",)], "x string").select(*[c.alias(n) for n, c in counts.items()]).first()
    assert (row["k_keywords"], row["r_keywords"]) == (2, 1)


def test_length_unit_is_checked(spark):
    df = spark.createDataFrame([("a b",)], "x string")
    assert text_lengths(df, ["x"], "word").first()["x"] == 2
    with pytest.raises(ValueError):
        text_lengths(df, ["x"], "byte")


def test_text_needs_one_column(spark):
    df = spark.createDataFrame([(" ", 1)], "designation string, k int")
    assert df.select(build_text(df).alias("t")).first()["t"] == "[EMPTY]"
    with pytest.raises(ValueError):
        build_text(df.drop("designation"))


def test_digits_of_other_scripts_are_numbers(spark):
    df = spark.createDataFrame([(1, "٣ kg de thé"), (2, "3 kg de thé"), (3, "１２ cm"), (4, "12 cm")], "id int, x string")
    got = {r["id"]: r["x"] for r in replace_measures(df, ["x"], "light").collect()}
    assert got[1] == got[2] and got[3] == got[4]
    rows = {r["id"]: r["base_value"] for r in extract_measures(df, "x", ["id"]).collect()}
    assert rows[1] == rows[2] == 3.0 and rows[3] == rows[4] == 12.0


# Golden rows: lower bounds and labels of every bucketed measure
EDGES = {
    "volume": ((0, "petit volume"), (5000, "volume moyen"), (1500000, "grand volume")),
    "surface": ((0, "petite surface"), (1600, "surface moyenne"), (20000, "grande surface")),
    "length": ((0, "petite longueur"), (10, "longueur moyenne"), (40, "grande longueur"), (350, "très grande longueur")),
    "weight": ((0, "poids leger"), (1.5, "poids moyen"), (20, "poids lourd")),
    "price": ((0, "prix bas"), (20, "prix moyen"), (100, "prix eleve")),
    "age": ((0, "age bébé"), (3, "age enfant"), (15, "age adulte")),
    "memory": ((0, "petite mémoire"), (8, "mémoire moyenne"), (64, "grande mémoire")),
    "date": ((1800, "date ancienne"), (1960, "date contemporaine"), (2007, "date récente"), (2021, "date future")),
    "numero": ((0, "petit numero"), (20, "grand numero")),
    "card": ((0, "peu de cartes"), (5, "beaucoup de cartes")),
    "piece": ((0, "peu de pièces"), (3, "beaucoup de pièces")),
    "integer": ((0, "zéro"), (1, "un"), (2, "petit nombre"), (5, "nombre moyen"), (20, "grand nombre"), (100, "très grand nombre")),
    "float": ((0, "petite quantité"), (1, "quantité moyenne"), (10, "grande quantité"), (100, "très grande quantité")),
}


@pytest.mark.parametrize("measure", sorted(EDGES))
def test_every_bucket_edge(spark, measure):
    edges = EDGES[measure]
    want = [(edges[0][0] - 1e-6, measure + "inconnu"), (None, measure + "inconnu"), (float("inf"), measure + "inconnu")]
    for i, (low, label) in enumerate(edges):
        want.append((float(low), label))
        if i:
            want.append((low - 1e-6, edges[i - 1][1]))
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(want)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(bucket_label(F.col("v"), measure)).collect()] == [x for _, x in want]
    as_sql = _label("v", next(m for m in measures_of("full") if m.name == measure)) if measure in {m.name for m in measures_of("full")} else None
    if as_sql:
        assert [r[0] for r in df.orderBy("i").selectExpr(as_sql).collect()] == [x for _, x in want]


FACTORS = {
    "mm": 0.1, "cm": 1, "dm": 10, "m": 100, "mm2": 0.01, "cm2": 1, "dm2": 100, "m2": 10000, "mm3": 0.001, "cm3": 1,
    "dm3": 1000, "m3": 1000000, "ml": 1, "cl": 10, "dl": 100, "l": 1000, "g": 0.001, "kg": 1, "tonne": 1000,
    "mois": 1 / 12, "ans": 1, "mo": 0.001, "go": 1, "to": 1000, "gb": 1, "mètres": 100, "Centimétre": 1, "millimetres": 0.1,
    "grammes": 0.001, "kilos": 1, "kilogramme": 1, "tonnes": 1000, "litre": 1000, "centilitres": 10, "millilitre": 1, "an": 1,
}


def test_every_unit_factor(spark):
    df = spark.createDataFrame([(u,) for u in FACTORS], "u string")
    got = {r[0]: r[1] for r in df.select("u", unit_factor(unit_symbol(F.col("u")))).collect()}
    assert got == {u: pytest.approx(f) for u, f in FACTORS.items()}


def test_keywords_that_stay_apart_are_searched_without_patterns(spark):
    texts = ["jeux jeu jeujeux", "xjeuxjeu", "JEU jeU", "", None, "é😀jeux\0jeu\njeux", "bébé bebe bébébébé", "lotlot elotaaaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    apart = {"words": ["jeu", "lot"], "accents": ["bébé", "oh"], "itself": ["aa", "lot"]}
    meet = {"first": ["jeu", "jeux"], "longer": ["jeux", "jeu"], "ends": ["bébé", "ébéb"], "twice": ["jeu", "jeu"]}

    def counted(terms):
        return df.select("x", *[c.alias(n) for n, c in keyword_counts(F.col("x"), terms).items()])

    for terms in (apart, meet):
        for r in counted(terms).collect():
            for name, words in terms.items():
                assert r[f"{name}_keywords"] == len(re.findall("|".join(words), r["x"] or ""))
        assert {f.dataType.simpleString() for f in counted(terms).schema.fields[1:]} == {"int"}
    plan = counted(apart)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
