import numpy as np
import pytest
from pyspark.sql import functions as F

from gigmatch.llm import mixing, token_counts


def test_totals_meet_targets(spark, sf1):
    got = mixing.op8_soft_membership_mixing(spark, sf1).toPandas()
    assert len(got) == spark.read.parquet(f"{sf1}/documents.parquet").count()
    assert (got.rate >= 0).all()
    p = got[[f"p_{d}" for d in mixing.TARGETS]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    totals = (p * (got.tokens * got.rate).to_numpy()[:, None]).sum(0)
    assert np.allclose(totals / totals.sum(), list(mixing.TARGETS.values()), atol=1e-3)
    labels = spark.read.parquet(f"{sf1}/labels.parquet").toPandas().merge(got, on="doc_id")
    domain = np.where(labels.toxic == 1, 2, np.where(labels.quality == 0, 1, 0))
    assert (labels[[f"p_{d}" for d in mixing.TARGETS]].to_numpy().argmax(1) == domain).mean() > 0.95


def direct_fit(p, tokens, want):
    """Nonnegative least squares on all documents at once: projected gradient from rates of 1, token-weighted."""
    rates, a = np.ones(len(p)), p * tokens[:, None]
    gram = np.linalg.inv(a.T @ p)
    for _ in range(4000):
        rates = np.maximum(0, rates - 0.5 * p @ gram @ (a.T @ rates - want))
    return rates


@pytest.mark.parametrize("targets", [[0.7, 0.2, 0.1], [0.2, 0.2, 0.6], [0.85, 0.1, 0.05]])
def test_rates_against_a_direct_fit(spark, targets):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = rng.integers(1, 500, 300)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    steps, told = mixing.fit_rates(members, targets)
    rates = np.array([r.r for r in members.select(mixing.rate(F.col("p"), steps).alias("r")).collect()])
    want = np.array(targets) * (p[:, 0] @ tokens) / targets[0]
    assert (rates >= 0).all() and told["steps"] < mixing.STEPS and np.allclose(told["want"], want)
    direct = direct_fit(p, tokens, want)
    total = lambda r: (p * (tokens * r)[:, None]).sum(0)
    assert np.allclose(total(rates), want, rtol=1e-3) and np.allclose(total(direct), want, rtol=1e-3)
    assert tokens @ (rates - 1) ** 2 <= 1.1 * (tokens @ (direct - 1) ** 2) + 1e-6


def test_tokens_are_counted_whole(spark, odd):
    got = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd).collect()}
    model = mixing.DomainModel(["a"], {}, np.ones(len(mixing.NAMES)), np.zeros((len(mixing.NAMES) + 1, 1)))
    members = mixing.memberships(odd.select("doc_id", "text"), model).collect()
    assert {(r.doc_id, r.tokens) for r in members} == got


def test_posteriors_on_labels_that_were_not_learned(spark, sf1):
    docs, labels = spark.read.parquet(f"{sf1}/documents.parquet"), spark.read.parquet(f"{sf1}/labels.parquet")
    domains = list(mixing.TARGETS)
    model = mixing.train(docs.select("doc_id", "text"), labels.filter("doc_id % 3 <> 0"), domains)
    rest = labels.filter("doc_id % 3 = 0").join(docs, "doc_id").select("text", mixing.label_domain(F.col("quality"), F.col("toxic")).alias("d")).dropna().collect()
    p = model.posteriors(model.look([r.text for r in rest])[0])
    y = np.array([domains.index(r.d) for r in rest])
    assert (p.argmax(1) == y).mean() > 0.9
    assert abs(p.max(1).mean() - (p.argmax(1) == y).mean()) < 0.08  # as sure as they are right


def test_rates_above_one_repeat_rows(spark, sf1):
    docs = spark.read.parquet(f"{sf1}/documents.parquet")
    labels = spark.read.parquet(f"{sf1}/labels.parquet")
    targets = {"clean": 0.7, "low": 0.18, "toxic": 0.12}
    got = mixing.sample_by_rate(docs, labels, targets, most=3.0, stored=True)
    assert got.columns == docs.columns
    counts = got.groupBy("doc_id").count()
    assert 1 < counts.agg(F.max("count")).first()[0] <= 3
    model = mixing.train(docs.select("doc_id", "text"), labels, list(targets))
    sums = mixing.memberships(got, model).agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(k))) for k in range(3)]).first()
    assert np.allclose(np.array(sums) / sum(sums), list(targets.values()), atol=0.03)


def test_copies_are_drawn_by_rate(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = mixing.with_rows(docs, "copies")
    rates = rows.select("_row", F.when(F.col("doc_id") < 1000, 0.0).when(F.col("doc_id") < 2000, 1.0).when(F.col("doc_id") < 3000, 2.5).otherwise(0.25).alias("rate"))
    got = {r.k: r.n for r in mixing.draw_copies(rows, rates).groupBy(F.floor(F.col("doc_id") / 1000).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert 0 not in got and got[1] == 1000 and abs(got[2] - 2500) < 80 and abs(got[3] - 250) < 70


def test_odd_rows(odd, none, labels):
    got = mixing.mix(odd, labels).collect()
    assert len(got) == odd.count() and all(r.rate >= 0 for r in got)
    assert {r.tokens for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix(none, labels).count() == 0
    equal = mixing.mix(odd, labels.limit(0)).first()
    assert equal.p_clean == pytest.approx(1 / 3)
    kept = mixing.sample_by_rate(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


@pytest.mark.parametrize("low, toxic", [(0.02, 0.01), (0.005, 0.002), (0.0, 0.0), (0.3, 0.01), (0.25, 0.15)])
def test_bounded_rates_keep_clean_documents(spark, low, toxic):
    rng = np.random.default_rng(4)
    domain = rng.choice(3, 4000, p=[1 - low - toxic, low, toxic])
    p = np.array([rng.dirichlet(np.where(np.arange(3) == d, 40.0, 0.3)) for d in domain])
    tokens = rng.integers(50, 500, 4000)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    targets = list(mixing.TARGETS.values())
    steps, _ = mixing.fit_kept(members, targets)
    rates = np.array([r.r for r in members.select(mixing.rate(F.col("p"), steps, 1.0).alias("r")).collect()])
    assert (rates >= 0).all() and (rates <= 1).all() and rates[domain == 0].mean() > 0.98
    totals = (p * (tokens * rates)[:, None]).sum(0)
    have = (p * tokens[:, None]).sum(0)
    want = np.minimum(np.array(targets) * have[0] / targets[0], have)
    assert np.allclose(totals, want, rtol=0.1)  # dropped documents carry some of the scarce domain's tokens with them


@pytest.mark.parametrize("known", [[], [(1, 1, 0), (2, 0, 0)]])
def test_labels_without_a_domain_drop_nothing(spark, known):
    docs = spark.createDataFrame([(i, f"word{i % 7} and other words number {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    assert mixing.sample_by_rate(docs, labels).count() == 60


def test_a_row_is_drawn_by_its_own_rate(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good"), (1, "bad"), (None, "good"), (None, "bad")], "doc_id long, text string")
    rates = lambda rows, labels, targets, most: rows.select("_row", F.when(F.col("text") == "bad", 0.0).otherwise(1.0).alias("rate"))
    monkeypatch.setattr(mixing, "kept_rates", rates)
    kept = mixing.sample_by_rate(docs, docs)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "good"), (1, "good")]


def shapes(n, seed):
    """Documents of three kinds that lines and words tell apart."""
    rng = np.random.default_rng(seed)
    word = lambda kind: f"{kind}{rng.integers(0, 40)}"
    return lambda kind: " ".join(word(kind if rng.random() < 0.5 else "w") for _ in range(n))


def test_a_rare_domain_is_not_missed_by_the_sample(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TRAIN_DOCS", 600)
    make, rows, labels = shapes(20, 1), [], []
    kinds = ["clean"] * 19_000 + ["low"] * 960 + ["toxic"] * 40
    for i, kind in enumerate(kinds):
        rows.append((i, make(kind), kind))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(8)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.train(docs.select("doc_id", "text"), table, list(mixing.TARGETS), 600)
    assert model.seen == set(mixing.TARGETS) and model.gain > 100
    targets = {"clean": 0.985, "low": 0.0145, "toxic": 0.0005}
    kept = {r.kind: r.n for r in mixing.sample_by_rate(docs, table, targets).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kept["clean"] > 0.97 * 19_000 and kept["low"] < 500 and kept.get("toxic", 0) < 25


def test_texts_that_tell_nothing_are_not_mixed(spark):
    rng = np.random.default_rng(2)
    kinds = rng.choice(3, 3000, p=[0.6, 0.3, 0.1])
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 30))) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds.tolist())], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in mixing.sample_by_rate(docs, labels).collect()}
    assert len([i for i in kept if kinds[i] == 0]) >= 0.95 * (kinds == 0).sum()


def test_weak_posteriors_don_t_cost_the_first_domain(spark):
    members = spark.createDataFrame([(100, [0.6, 0.3, 0.1])] * 50, "tokens long, p array<double>")
    steps, told = mixing.fit_kept(members, list(mixing.TARGETS.values()))
    assert told["got"][0] >= (1 - mixing.LOSS) * told["have"][0]
