import hashlib
import random
import re

from tallyframe.llm import pii
from tests.llm import edge

# the plain patterns, word for word
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), order, m.end()) for m in re.finditer(pattern, text) if good(kind, m[0])]
    return sorted(spans)


def test_random_texts():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x", ".com", "-", " ", "+", "+1", "12", "4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "(", ")",
             "+49 (30) 1234-5678", "..", "é", "me@ex.org", "_%", "0", "4111-1111-1111-1111"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.identifiers(text) == brute(text), text


def test_edge_rows(spark):
    docs = edge.table(spark)
    found = pii.digest(pii.find_personal_data(docs)).collect()
    assert len(found) == docs.count()
    assert {r.base_sha256 for r in found if r.doc_id in (4, 5)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_personal_data(edge.empty(spark)).count() == 0
    assert pii.redact_documents(docs).schema == docs.schema
    assert pii.redact_documents(edge.empty(spark)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.digest(pii.find_personal_data(docs)).collect():
        spans = brute(texts[r.doc_id])
        line = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert not line or set(line.split(",")) <= set(r.spans.split(","))
    assert not any(brute(r.text or "") for r in pii.redact_documents(docs).collect())


def spans(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.personal_data(text)[1]]


def test_disguises():
    assert spans("write to joe [at] mail (dot) example [dot] org now") == [("email", "joe [at] mail (dot) example [dot] org")]
    assert spans("write to joe at mail dot org now") == [("email", "joe at mail dot org")]
    assert spans("jое＠mail．org!") == [("email", "jое＠mail．org")]
    assert spans("call plus one five five five one two three four five six seven please") == [
        ("phone", "plus one five five five one two three four five six seven")
    ]
    assert spans("١٠.٠.٠.١ and 10.0​.0.1") == [("ip", "١٠.٠.٠.١"), ("ip", "10.0​.0.1")]
    assert spans("look at the dots at noon. Dot went home") == []
    assert pii.redacted("a b@c.de, +49 30 1234 5678 x") == "a [EMAIL], [PHONE] x"


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, " " * 300_000, "@" * 300_000, "a@" * 100_000, "+1" * 150_000, "[at" * 100_000):
        pii.personal_data(text)
