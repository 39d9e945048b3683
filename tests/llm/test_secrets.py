"""Secrets by their places in hand-made texts, not by the pattern of the scan."""

from __future__ import annotations

import pytest

from assay.llm import secrets

VALUES = {
    "password: hunter2secret": "hunter2secret",
    'api_key: "qwertyuiopasdfghjklzxcvb"': "qwertyuiopasdfghjklzxcvb",
    'password = "Tr0ub4dor&3!xyz#Qw9$k2m"': "Tr0ub4dor&3!xyz#Qw9$k2m",
    "pwd='a b c' rest": "a b c",
    '{"password":"x\\"y","user":"bob"}': 'x\\"y',
    "AWS_SECRET_KEY=short1, next": "short1",
}


@pytest.fixture(scope="module")
def found(spark):
    """Candidates by text, measured and with the rule's label."""
    def run(texts):
        docs = spark.createDataFrame([(t,) for t in texts], "text string")
        rows = secrets.measured(secrets.candidates(docs, ["text"]), []).withColumn("label", secrets.label()).collect()
        return {t: [r for r in sorted(rows, key=lambda r: r.k) if r.text == t] for t in texts}

    return run


def test_values_behind_key_names(found, spark):
    for text, rows in found(VALUES).items():
        assert [(r.value, r.start, r.label) for r in rows] == [(VALUES[text], text.index(VALUES[text]), 1)], text
    assert found(["author wrote: this. token="]) == {"author wrote: this. token=": []}
    docs = spark.createDataFrame([(t, "card 4111111111111111") for t in VALUES], "text string, other string")
    out = secrets.redact(docs.unionByName(docs.selectExpr("other AS text", "other")))
    assert {r.text for r in out.collect()} == {t.replace(v, secrets.MASK) for t, v in VALUES.items()} | {"card 4111111111111111"}


JSON_TOKEN = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
V = "abcd1234efgh5678ijkl"


@pytest.mark.parametrize("text, value, label", [
    (f"AWS_SECRET_KEY={V} end", V, 1), (f"a {JSON_TOKEN} b", JSON_TOKEN, 1), (f"a {V}.{V}.{V[:6]} b", f"{V}.{V}.{V[:6]}", None),
    (f"https://user:{V}@host.org/x", V, None), (f"https://h.org/p?key={V}&x=1", V, None), (f"x SESSION={V} y", V, None), (f"A=B={V}", V, None),
    (f"see /usr/lib/{V}, and", f"/usr/lib/{V}", 0), (f"https://{V}.example.com/x", f"//{V}", 0), (f"commit={V}", V, 0),
    ("sessionid1234567890=1", "sessionid1234567890=1", None), ("authority=short1234567", "authority=short1234567", None),
])
def test_labels_of_places(found, text, value, label):
    assert [(r.value, r.label) for r in found([text])[text]] == [(value, label)]


def test_long_runs_without_end(found):
    for text in ("a=" * 100_000, "a" * 200_000, "abcdefgh." * 20_000, '"' + "x\\\"" * 50_000):
        assert found([text])[text] == []
