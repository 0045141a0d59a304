import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.functions.stemming import porter
from gristmill.operators import textprep, textprofile


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        [(1, "Don't stop; l'été Été 12½!", "x"), (2, "", "x"), (3, " \t\n", None), (4, None, "y"), (5, "Run RUN run fast", "y"),
         (6, "Run RUN run fast", "y")], "id long, t string, y string")


def test_counts(texts):
    r = textprofile.text_counts(texts, "t").first()
    assert tuple(r) == (6, 1, 1, 2)


def test_tokens(texts):
    got = {r["id"]: r["w"] for r in texts.select("id", X.tokens(F.col("t")).alias("w")).collect()}
    assert got[1] == ["don't", "stop", "l'été", "été"] and got[2] == [] and got[4] is None


def test_lengths_and_null_text(texts):
    got = {r["column"]: r for r in textprofile.length_profile(texts, "t").collect()}
    assert got["char_lengths"]["count"] == 5 and got["word_lengths"]["max"] == 4.0
    words = [4, 0, 0, 4, 4]
    assert got["word_lengths"]["std"] == pytest.approx(np.std(words)) and got["word_lengths"]["p90"] == np.quantile(words, 0.9)
    assert {r["column"]: r["count"] for r in textprofile.length_profile(texts, "t", "nan").collect()}["word_lengths"] == 6


def test_bigrams(texts):
    got = {r["token"]: r["count"] for r in textprofile.token_counts(texts, "t", n=2).collect()}
    assert got["run run"] == 4 and got["run fast"] == 2 and got["don't stop"] == 1 and len(got) == 5


def test_labels_and_repeats(texts):
    got = {r["label"]: (r["mean_chars"], r["mean_words"]) for r in textprofile.label_lengths(texts, "t", "y").collect()}
    assert got["NaN"] == (3.0, 0.0) and got["y"] == (16.0, 4.0)
    assert textprofile.duplicate_texts(texts, "t").first()[0] == 1
    long = texts.select(F.repeat(F.coalesce("t", F.lit("z")), 40).alias("t"))
    top = textprofile.top_duplicate_texts(long, "t").collect()
    assert [(len(r["text"]), r["count"]) for r in top] == [(120, 2)]


def test_makeup_of_nothing(spark):
    df = spark.createDataFrame([], "t string")
    assert tuple(textprofile.character_makeup(df, "t").first()) == (0.0, 0.0, 0.0)
    assert textprofile.character_makeup(spark.createDataFrame([("½ a_B!1",)], "t string").select("t"), "t").first()[1] == pytest.approx(100 / 7)


def test_missing_text_column(texts):
    with pytest.raises(ValueError):
        textprofile.text_counts(texts, "absent")


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
    ("triplicate", "triplic"), ("hopefulness", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"),
    ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("at", "at"),
])
def test_stems(word, stem):
    assert porter(word) == stem


def test_clean_words(spark):
    df = spark.createDataFrame([("The cats' running_fast, isn't 3-fold!",), (None,)], "t string")
    got = [r[0] for r in textprep.clean_words(df, "t", stemming=True).select("clean_text").collect()]
    assert got == ["cat runningfast isn 3 fold", ""]


def test_cleaning_switches(spark):
    df = spark.createDataFrame([("<b>Ｆｕｌｌ</b> width&nbsp;text can't wait: mail a.b@c.org or http://x.y/z?q=1 now 42",)], "t string")
    cfg = textprep.CleaningSwitches(stopwords=False, strip_numbers=True)
    assert textprep.clean_text(df, "t", cfg=cfg).first()["clean_text"] == "full width text can not wait mail or now"


def test_lemmas_keep_order_and_empty_lists(spark):
    df = spark.createDataFrame([(1, ["mice", "ran", "mice"]), (2, []), (3, None)], "id long, w array<string>")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("ran", "run")], "token string, lemma string")
    found = {r["id"]: r["w"] for r in textprep.lemmatize(df, "w", lemmas).collect()}
    assert found == {1: ["mouse", "run", "mouse"], 2: [], 3: None}


def test_lemmas_of_several_parts_without_a_shuffle_of_rows(spark, monkeypatch):
    monkeypatch.setattr(textprep, "LOOKED_UP", 2)
    monkeypatch.setattr(textprep, "PARTS_KEPT", 1)
    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i)] + [None, "x"]) for i in range(9)], "id long, w array<string>")
    lemmas = spark.createDataFrame([(f"w{j}", f"w{j + 1}") for j in range(7)] + [("w3", "a"), ("x", None), (None, "y")], "token string, lemma string")
    got = textprep.lemmatize(df, "w", lemmas)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    want = {j: f"w{j + 1}" for j in range(7)} | {3: "a", 7: "w7"}
    assert {r["id"]: r["w"] for r in got.collect()} == {i: [want[j] for j in range(i)] + [None, "x"] for i in range(9)}


def test_tfidf_against_definition(spark):
    docs = ["red fish blue fish", "one fish", "", "blue sky one two"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string")
    model = textprep.fit_term_vectors(df, "t", ngram=(1, 2), max_features=4)
    terms = [[w for w in d.split()] + [f"{a} {b}" for a, b in zip(d.split(), d.split()[1:])] for d in docs]
    total = Counter(t for ts in terms for t in ts)
    vocab = sorted(t for t, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:4])
    assert textprep.vocabulary_of(model) == vocab
    for r in model.transform(df).select("id", vector_to_array("features").alias("v")).collect():
        tf = Counter(terms[r["id"]])
        w = np.array([tf[t] * (math.log(5 / (1 + sum(t in ts for ts in terms))) + 1) for t in vocab])
        assert r["v"] == pytest.approx(list(w / (np.linalg.norm(w) or 1)))


def test_terms_are_counted_by_batch(spark, monkeypatch):
    import pyarrow as pa

    lists = [["a", "b", "a"], None, [], ["b"], ["a", None, None, "c"], ["c", "c", "c"]]
    expected = {t: (sum((x or []).count(t) for x in lists), sum(t in (x or []) for x in lists)) for t in ("a", "b", "c", None)}
    for together in (1, 3, 1_000):
        monkeypatch.setattr(textprep, "TERMS_TOGETHER", together)
        for part in (lists, [["z"], *lists]):
            batch = pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["t"]).slice(len(part) - len(lists))
            (found,) = textprep.count_terms([batch])  # a row a term
            assert {r["term"]: (r["total"], r["docs"]) for r in found.to_pylist()} == expected and len(found) == 4
        for part in ([], [[], None]):
            (found,) = textprep.count_terms([pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["t"])])
            assert len(found) == 0
    df = spark.createDataFrame([(x,) for x in lists], "`a.t` array<string>")
    counted = textprep.term_statistics(df, "a.t")
    assert {r["term"]: (r["total"], r["docs"]) for r in counted.collect()} == expected
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()  # no row for each occurrence


def test_tfidf_columns_drop_all_null(spark):
    df = spark.createDataFrame([("big cat", None), ("dog", None)], "a string, b string")
    model, made = textprep.fit_tfidf_columns(df, ["a", "b"])
    assert made == ["a_tfidf"] and model.transform(df).columns == ["a_tfidf"]


def test_mean_pool(spark):
    df = spark.createDataFrame([("g", [1.0, 2.0], 1), ("g", [3.0, 6.0], 1), ("g", [100.0, 100.0], 0)], "g string, v array<double>, m int")
    assert {r["dim"]: r["value"] for r in textprep.mean_pool(df, "g", "v", "m").collect()} == {0: 2.0, 1: 4.0}


def test_stems_stay_in_arrow():
    import pyarrow as pa

    from gristmill.operators.textprep import stem_words

    words = pa.array([["gone"], ["running", "cats", "running"], None, [], ["cats", None]], pa.list_(pa.string()))
    assert stem_words.func(words[1:]).to_pylist() == [["run", "cat", "run"], None, [], ["cat", None]]
    assert stem_words.func(words[:0]).to_pylist() == []


def test_queries_are_weighed_in_parts():
    import pandas as pd

    from gristmill.operators import retrieve

    assert [len(f) for f in retrieve._in_parts([pd.DataFrame({"q": range(450)}), pd.DataFrame({"q": []})], 200)] == [200, 200, 50]
