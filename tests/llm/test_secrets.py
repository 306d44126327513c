import numpy as np

from tests.llm.cases import HARD, empty, hard
from tidewatch.llm import secrets


def test_held_out_accuracy():
    x, y = [], []
    for text, label in secrets.labelled(77):
        spans = secrets.candidates(text)
        if spans:
            x.append(secrets.features(text, *max(spans, key=lambda s: s[1] - s[0])))
            y.append(label)
    assert len(x) > 500 and np.mean((secrets.default_model().score(np.array(x)) >= 0.5) == np.array(y)) > 0.97


def test_scan(spark):
    rows = [(1, 'set token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" now'), (2, "commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 fixed it"), (3, "id 123e4567-e89b-12d3-a456-426614174000 in /usr/lib/x86_64-linux/thing12/file.txt")]
    got = {r.doc_id: [(rows[r.doc_id - 1][1][c.start:c.end], c.score >= 0.5) for c in r.candidates] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("9b0b3c6a43eb78aa99cbd7049c572391524f37a8", True)] and got[2] == [("9b0b3c6a43eb78aa99cbd7049c572391524f37a8", False)]
    assert got[3] and not any(kept for _, kept in got[3])


def test_hard_cases(spark):
    assert sorted((r.doc_id or 0, len(r.candidates)) for r in secrets.scan(hard(spark)).collect()) == sorted((i or 0, 0) for i, _, _ in HARD)
    assert secrets.scan(empty(spark)).count() == 0
    assert secrets.candidates("a1" * 50_000) == [(0, 100_000)]


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in secrets.op10_secret_scan(spark, "/root/testdata/sf0.01").collect():
        assert (r.n_secrets > 0) == ('token = "' in texts[r.doc_id])


def test_values_of_any_length_and_class():
    cases = {
        'password = "Tr0ubad0r9"': "Tr0ubad0r9", "see postgres://u:S3cretPw@host now": "S3cretPw", "api_key=qhzkwvtrbnmxpl": "qhzkwvtrbnmxpl",
        "api_key: 839201745523": "839201745523", '{"db_password": "hx9!kPq#"}': "hx9!kPq#", "the password is hunter2x": "hunter2x",
        "url?lang=en&token=Ab3kd9Xq&x=1": "Ab3kd9Xq", 'passwd="n0t-/clos': "n0t-/clos",
    }
    for text, secret in cases.items():
        spans = secrets.candidates(text)
        assert secret in [text[a:b] for a, b in spans], text
        scores = secrets.default_model().score(np.array([secrets.features(text, *s) for s in spans]))
        assert [text[a:b] for (a, b), s in zip(spans, scores, strict=True) if s >= 0.5] == [secret], text
    for text in ("note: the house", "port=8080", "the password must be changed", "password = None", "at 12:30 in https://www.example.com/a", "author: Anna"):
        spans = secrets.candidates(text)
        assert not spans or max(secrets.default_model().score(np.array([secrets.features(text, *s) for s in spans]))) < 0.5, text
    for text in ("a=" * 30_000, "=-" * 30_000, ":\"" * 30_000, "://a:" * 20_000, "secret" * 10_000):  # no quadratic steps
        secrets.candidates(text)


def test_features_and_scores_one_by_one():
    """Counts over whole candidates, the end of long ones included, and the trees walked node by node."""
    long = "aB3" * 300
    for word in ("0123456789abcdef", long, long + "/x", long + "-" * 3 + "1"):
        text = f"key = '{word}'"
        start = text.index(word)
        got = dict(zip(secrets.FEATURES, secrets.features(text, start, start + len(word)), strict=True))
        assert got["length"] == len(word) and got["slashes"] == word.count("/") and got["dashes"] == word.count("-")
        assert abs(got["digits"] * len(word) - sum(c.isdigit() for c in word)) < 1e-9 and got["quoted"] == 1
        assert got["hex"] == all(c in "0123456789abcdefABCDEF" for c in word)
    forest = secrets.default_model()
    x = np.array([secrets.features(t, *s) for t, _ in secrets.labelled(13)[:150] for s in secrets.candidates(t)])

    def walk(tree, row, at=0):
        feature, cut, left, right, share = tree[at]
        return share if feature < 0 else walk(tree, row, int(left if row[int(feature)] <= cut else right))

    plain = [np.mean([walk(tree, row) for tree in forest.trees]) for row in x]
    assert len(x) > 100 and np.allclose(forest.score(x), plain)
