import numpy as np

from headwater.llm.toxicity import fit, grade_toxicity, loss_and_gradient, minimise, severity_grades, thresholds_of, without_toxic


def test_gradient():
    rng = np.random.default_rng(1)
    rows = [rng.choice(6, 3, replace=False) for _ in range(20)]
    grades, weights = rng.integers(0, 3, 20), rng.random(20)
    at = rng.normal(size=8)
    _, gradient = loss_and_gradient(at, 6, rows, grades, weights)
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-6
        up, down = (loss_and_gradient(at + s * step, 6, rows, grades, weights)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-5


def test_minimise():
    goal = np.arange(5.0)
    scale = np.array([1, 10, 100, 3, 0.1])
    found = minimise(lambda x: (float(scale @ (x - goal) ** 2), 2 * scale * (x - goal)), np.zeros(5), 200)
    assert np.abs(found - goal).max() < 0.05


def test_ordered_grades(spark):
    texts = {0: "fine words here", 1: "bad words here", 2: "vile words here"}
    rows = [(i, texts[i % 3], "x") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    grades = spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id long, grade int")
    model = fit(docs, grades)
    assert (np.diff(model.thresholds) > 0).all() and np.allclose(thresholds_of(np.array([0.0, 0.0])), [0, 1])
    severity, toxic = model.judge([texts[0], texts[1], texts[2], ""])
    assert severity[0] < 0.3 < 0.7 < severity[1] < 1.3 < 1.7 < severity[2] and toxic[0] < 0.5 < toxic[1]


def test_odd_rows(spark):
    rows = [(i, "fine words" if i % 2 else "vile words", "en", "s", 1, "x") for i in range(40)]
    rows += [(None, None, None, None, None, None), (50, "", "en", "s", 0, "x"), (50, "vile " * 50_000, "en", "s", 0, "x"), (50, "vile " * 50_000, "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic string")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.toxic) for r in grade_toxicity(docs, labels).collect()}
    assert {g for g in got if g[0] is not None and g != (50, False)} == {(i, i % 2 == 0) for i in range(40)} | {(50, True)}
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 50} == {i for i in range(40) if i % 2}
    assert grade_toxicity(docs.limit(0), labels).count() == 0
    none = grade_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.toxic or r.severity for r in none)


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in severity_grades(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: 1, 5: None}


def test_labels_of_absent_documents(spark):
    docs = spark.createDataFrame([(i, "fine words") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(99, 1, 1)], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in grade_toxicity(docs, labels).collect())


def test_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in grade_toxicity(docs, labels.where("doc_id % 3 != 0")).collect() if r.doc_id in truth and r.doc_id % 3 == 0]
    clean = [r for r in got if truth[r.doc_id] == 0]
    bad = [r for r in got if truth[r.doc_id] == 1]
    # Measured: 15 of 1202 and 79 of 147. The rarer languages have too few toxic examples here, and the third
    # grade costs some; see the README.
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean) and sum(r.toxic for r in bad) >= 0.5 * len(bad)


def test_third_grade_costs_no_decisions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in grade_toxicity(docs, labels.where("doc_id % 3 != 0")).collect() if r.doc_id in truth and r.doc_id % 3 == 0]
    clean = [r for r in got if truth[r.doc_id] == 0]
    bad = [r for r in got if truth[r.doc_id] == 1]
    # Measured: 1 of 1202 and 96 of 147.
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean) and sum(r.toxic for r in bad) >= 0.6 * len(bad)
