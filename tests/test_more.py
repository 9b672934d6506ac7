"""Kernels against dense or brute-force versions, thresholds under skew, times with offsets, streams with empty batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.functions import scalars as S
from threadloom.graph import Graph, build, mentions_of, model_terms
from threadloom.operators import algorithms as A
from threadloom.operators import embedding as E
from threadloom.operators import relational as R
from threadloom.operators import text as X
from threadloom.operators import traversal as V
from threadloom.streaming import incremental as N


def test_svd_against_dense(spark):
    rng = np.random.default_rng(1)
    m = np.where(rng.random((40, 25)) < 0.3, rng.normal(size=(40, 25)), 0)
    cells = spark.createDataFrame([(f"r{i:02d}", f"c{j:02d}", float(m[i, j])) for i, j in np.argwhere(m)], "row string, col string, value double")
    vectors, sigma = E.svd(cells, 6)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert sigma == pytest.approx(s[:6], rel=1e-3)
    got = np.zeros((40, 6))
    for r in vectors.collect():
        got[int(r.row[1:])] = r.vector
    assert np.abs((got[:, :4] * u[:, :4]).sum(axis=0)) == pytest.approx(1, abs=1e-2)
    assert got.T @ got == pytest.approx(np.eye(6), abs=1e-6)


@pytest.mark.parametrize("least", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_jaccard_with_threshold(spark, least):
    """Prefixes and lengths lose no pair, also where one feature is in every set."""
    rng = np.random.default_rng(2)
    sets = {f"k{i:02d}": {"all", *(f"f{int(x)}" for x in rng.integers(0, 8, size=rng.integers(0, 7)))} for i in range(40)}
    rows = spark.createDataFrame([(k, f) for k, fs in sets.items() for f in fs], "k string, f string")
    got = {(r.a, r.b): (r.inter, round(r.jaccard, 9)) for r in R._jaccard_pairs(rows, "k", least).where(F.col("jaccard") >= least).collect()}
    want = {}
    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i / len(sets[a] | sets[b]) >= least:
                want[a, b] = (i, round(i / len(sets[a] | sets[b]), 9))
    assert got == want


def test_candidates_are_not_gathered(spark, monkeypatch):
    """Features in many sets are dealt by parts, each pair is made once, and nothing is grouped above the join."""
    monkeypatch.setattr(R, "_TOGETHER", 4)
    rng = np.random.default_rng(5)
    sets = {f"k{i:02d}": {f"f{int(x)}" for x in rng.integers(0, 12, size=6)} for i in range(40)}
    found = R._similar_sets(spark.createDataFrame([(k, f) for k, fs in sets.items() for f in fs], "k string, f string"), "k", 0.2)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.2)
    assert sorted((r.a, r.b, r.inter) for r in found.collect()) == want


def test_best_conversations_by_falling_bounds(spark, monkeypatch):
    """The best pairs are the same whether a high bound finds enough of them or not."""
    from tests.test_graph import graph

    rng = np.random.default_rng(3)
    held = {f"m{i}": sorted({int(x) for x in rng.integers(0, 9, size=4)}) for i in range(12)}
    g = graph(spark, [], mentions=[(m, f"e{x}") for m, xs in held.items() for x in xs], contains=[(f"c{m[1:]}", m) for m in held])
    every = [tuple(r) for r in R.conversation_similarity(g, 0.02, 66, True).collect()]
    monkeypatch.setattr(R, "_MANY", 0)
    for top in (1, 30):
        assert [tuple(r) for r in R.conversation_similarity(g, 0.02, top, True).collect()] == every[:top]


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("2024-01-31T12:00:00Z", 1706702400), ("2024-01-31T12:00:00+02:00", 1706695200), ("2024-01-31T12:00:00.500-0530", 1706722200.5), ("2024-01-31 12:00:00+01", 1706698800),
        ("2024-01-31 12:00:00", 1706702400), ("1706702400000", 1706702400), ("2024-01-31", None), ("soon", None), (None, None),
    ],
)
def test_times_with_offsets(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_time(F.col("t"), offsets=True)).first()[0] == seconds


def test_language_of_whole_texts(spark):
    df = spark.createDataFrame([("x " * 3000 + "the and of to",)], "t string")
    assert df.select(X.detect_language(F.col("t")), X.detect_language(F.col("t"), chars=None)).first()[:] == ("unknown", "en")


@pytest.mark.parametrize(
    ("text", "lang"),
    [
        ("Der Zug ist nicht pünktlich, und die Leute warten auf dem Bahnsteig.", "de"),
        ("The train is late and people are waiting on the platform.", "en"),
        ("El tren no llega y los viajeros esperan en el andén con una manta.", "es"),
        ("Le train est en retard et les gens attendent sur le quai.", "fr"),
        ("Il treno non arriva e gli amici che sono nel bar aspettano.", "it"),
        ("Het is niet ver van het station, dat is een goede plek voor ons.", "nl"),
        ("To jest dom, w którym nie ma nikogo, ale jak się nie mylę, za rok.", "pl"),
        ("O comboio não chega e os amigos esperam em casa com uma manta para o frio.", "pt"),
        ("Это не так, как он сказал, но и не по плану.", "ru"),
        ("Det är inte för sent att åka med tåget till staden.", "sv"),
        ("Zug Zug Zug", "unknown"), ("", "unknown"), (None, "unknown"),
    ],
)
def test_languages(spark, text, lang):
    assert spark.createDataFrame([(text,)], "t string").select(X.detect_language(F.coalesce("t", F.lit("")))).first()[0] == lang


def test_ask(spark):
    """A model's answer per conversation; a call that fails leaves null and harms no other."""
    df = spark.createDataFrame([("a", "short"), ("b", "boom")], "conv_id string, context string")

    def call(question, context):
        if context == "boom":
            raise ValueError
        return f"{question} {len(context)}"

    assert {tuple(r) for r in R.ask(df, "how long?", call).collect()} == {("a", "how long? 5"), ("b", None)}


def test_components_that_do_not_settle(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "a string, b string")
    assert {r.component for r in V.components(chain).collect()} == {"n00"}
    with pytest.raises(RuntimeError, match="did not settle"):
        V.components(chain, most=1)


def messages(spark, rows):
    return spark.createDataFrame([(i, "user", t, None, 1.0, "c", "en") for i, t in rows], "id string, role string, text string, parent string, create_time double, conversation_id string, lang string")


def test_communities_of_components(spark):
    m = [(f"m{i}", "Alpha Bravo Charlie" if i < 3 else "Delta Edison Foxtrot") for i in range(6)]
    found = A.communities(build(messages(spark, m))).collect()
    assert len(found) == 6 and len({r.community for r in found}) == 2 and all(r.community <= r.id for r in found)


def test_empty_batches_keep_the_graph(spark, tmp_path):
    """A batch without rows leaves a gap between versions, and the next one builds on the last whole version."""
    fs = tmp_path / "in"
    fs.mkdir()
    target, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for k, text in enumerate(["Alpha meets Bravo", None, "Alpha meets Charlie"]):
        (fs / f"{k}.json").write_text("" if text is None else f'{{"id": "m{k}", "role": "user", "text": "{text}", "conversation_id": "c", "lang": "en"}}\n')
        N.watch(spark, str(fs), target, marks).awaitTermination()
    last = N._last_version(spark, target, 1 << 30)
    assert {r.id for r in Graph.read(spark, f"{target}/v{last}").of("Message").select("id").collect()} == {"m0", "m2"}
    assert N._last_version(spark, str(tmp_path / "none"), 5) is None


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_entities_of_a_model(spark):
    def find(texts):
        return [[(w, "PERSON") for w in t.split() if w == "ada"] + ([("2024", "DATE")] if "2024" in t else []) for t in texts]

    m = messages(spark, [("m1", "ada met ada in 2024"), ("m2", "nobody"), ("m3", None)])
    assert {tuple(r) for r in mentions_of(m, model_terms(find)).collect()} == {("m1", "entity::PERSON::ada", "ada", "PERSON")}
    with pytest.raises(Exception, match="0 answers"):
        mentions_of(m, model_terms(lambda texts: [])).collect()
