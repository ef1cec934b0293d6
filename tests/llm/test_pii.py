import hashlib
import random
import re

import pytest

from flowtables.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def brute(text):
    """Matches of the plain patterns, by kind, then start."""
    text = text or ""
    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
              if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def odd_texts():
    random.seed(3)
    parts = ["a", ".", "@", "b-c", "_", "%", "+", "1", "255", "256", "0001", " ", "-", "(", ")", "é", "😀",
             "4111111111111111", "4111 1111-1111 1111", "\n", "x.y", "+1 (743) 555-3824", "@b.c"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(1500)]
    return texts + [None, "", "a@b.c_d@e.f", "a@b.c.@x.y", "x@a..b", "1.2.3.4.5.6.7.8.9",
                    "x@" + "a." * 3000 + "b", "1" * 5000, "1 " * 5000, "+1" + " " * 3000, "a" * 20_000,
                    "1.2.3.4 " * 1500, "00000000000000000000000001.2.3.4"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, spans string")


def test_base_spans_against_the_plain_patterns(spark):
    texts = odd_texts()
    rows = pii.find(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = brute(texts[row.doc_id])
        assert [tuple(s) for s in row.base_spans] == expected, texts[row.doc_id]
        assert set(expected) <= {tuple(s) for s in row.spans}


def test_all_documents(spark, small):
    from flowtables.llm.queries import op10_pii
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op10_pii(spark, small).collect()
    assert len(rows) == len(documents)
    for row in rows:
        expected = brute(documents[row.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in expected)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(k == kind for k, _, _ in expected) for kind in pii.KINDS]


@pytest.fixture(scope="module")
def contexts():
    """Emails after "contact"; one address in a form that the exact pattern does not know."""
    texts = [f"please contact user{i}@mail{i}.example.com today" for i in range(30)]
    texts += ["please contact user77@intranet today", "order 12345678 of today", "order 99x today"]
    texts += [f"order {i}{i}{i}1234 came with +1 234 567 89{i:02d}" for i in range(30)]
    return texts


def test_contexts_find_unseen_identifiers(spark, contexts):
    rows = {r.doc_id: r for r in pii.find(table(spark, contexts)).collect()}
    assert [tuple(s) for s in rows[30].spans] == [("email", 15, 30)] and rows[30].base_spans == []
    for at, text in enumerate(contexts):
        if at != 30:
            assert rows[at].spans == rows[at].base_spans
            assert [tuple(s) for s in rows[at].base_spans] == brute(text)


def test_masks(spark, contexts):
    texts = contexts + ["+1 555-123-4567@x.yz and 1.2.3.4@a.bc", None, "", "none", "1.2.3.4" + " é" * 9000 + " a@b.cd x"]
    masked = [r.text for r in sorted(pii.mask(table(spark, texts)).collect(), key=lambda r: r.doc_id)]
    assert masked[0] == "please contact <EMAIL> today" and masked[30] == masked[0]
    assert masked[-5:] == ["<PHONE> and <IP>", None, "", "none", "<IP>" + " é" * 9000 + " <EMAIL> x"]


def test_empty_table(spark):
    assert pii.find(table(spark, ["x"]).limit(0)).count() == 0
    assert pii.mask(table(spark, ["x"]).limit(0)).count() == 0


def brute_discovered(texts, support=5, trust=0.9):
    """The bootstrap over sets, from the same tokens."""
    token = re.compile(pii.TOKEN)
    edges, known = {}, {}
    for text in texts:
        base = brute(text)
        spans = [(k, s, e) for k, s, e in base]
        for m in token.finditer(text):
            if 5 <= len(m[0]) <= 64 and not any(s < m.end() and e > m.start() for _, s, e in base):
                spans.append((None, m.start(), m.end()))
        for kind, start, end in spans:
            value = text[start:end].lower()
            before = re.search(r"([^\W\d_]+)[\W_]*$", text[:start][-80:])
            after = re.search(r"^[\W_]*([^\W\d_]+)", text[end:][:80])
            if kind:
                known[value] = max(known.get(value, ""), kind)
            for pattern in (before and f"{before[1].lower()} _", after and f"_ {after[1].lower()}"):
                if pattern:
                    edges.setdefault(pattern, set()).add(value)
    fits = {v: {k for k in pii.KINDS if re.search(pii.SHAPES[k], v)} for own in edges.values() for v in own}
    found = {}
    while True:
        best = {}
        for values in edges.values():
            for kind in pii.KINDS:
                seeds = sum(known.get(v) == kind for v in values)
                all_known = sum(v in known or kind not in fits[v] for v in values)
                if seeds >= support and seeds / all_known >= trust:
                    for v in values:
                        if v not in known and kind in fits[v]:
                            best[v] = max(best.get(v, (0, "")), (seeds / all_known, kind))
        if not best:
            return found
        found.update({v: kind for v, (_, kind) in best.items()})
        known.update({v: kind for v, (_, kind) in best.items()})


def chain():
    """Forms that are found one after the other, and words that may not be trusted."""
    texts = [f"contact user{i}@mail.example.com now" for i in range(20)]
    texts += [f"contact user{i}@intranet now" for i in range(30, 35)]              # after the first word
    texts += [f"reach user{i}@intranet by day" for i in range(30, 35)]             # the same tokens elsewhere
    texts += [f"then reach other{i}@lan by night" for i in range(5)]               # seeds were discovered
    texts += [f"at user{i}@mail.example.com we met" for i in range(10)]
    texts += [f"at 2024-01-0{i} we met" for i in range(1, 9)] + ["at someone@home we met"]
    texts += [f"paid 12345678901{i}x and 1234-5678-{i}" for i in range(9)]
    return texts


def test_bootstrap_reaches_a_fixed_point(spark):
    texts = chain()
    expected = brute_discovered(texts)
    assert {f"user{i}@intranet" for i in range(30, 35)} | {f"other{i}@lan" for i in range(5)} == set(expected)
    rows = {r.doc_id: r for r in pii.find(table(spark, texts)).collect()}
    for at, text in enumerate(texts):
        extra = {text[s.start:s.end].lower(): s.kind for s in rows[at].spans if s not in rows[at].base_spans}
        assert extra == {v: k for v, k in expected.items() if v in text.lower()}, text


def test_bootstrap_against_sets_on_random_texts(spark):
    draw = random.Random(11)
    values = [f"u{i}@x.com" for i in range(25)] + [f"u{i}@lan" for i in range(25)] + [
        f"10.0.{i}.7" for i in range(25)] + [f"10.0.{i}" for i in range(25)] + [f"{i}55512345" for i in range(20)] + [
        f"+1 555 123 45{i}" for i in range(10, 30)] + [f"v{i}.0.0" for i in range(20)]
    words = ["ask", "host", "dial", "run", "see"]
    texts = []
    for _ in range(250):
        word = draw.choice(words)
        own = draw.choice([values[:50], values[50:100], values[100:140], values[140:], values][words.index(word):][:1][0])
        texts.append(f"{word} {own} {draw.choice(['today', 'later', 'again', 'soon'])}")
    expected = brute_discovered(texts)
    assert expected
    rows = {r.doc_id: r for r in pii.find(table(spark, texts)).collect()}
    for at, text in enumerate(texts):
        extra = {text[s.start:s.end].lower(): s.kind for s in rows[at].spans if s not in rows[at].base_spans}
        tokens = {m[0].lower() for m in re.finditer(pii.TOKEN, text)}
        assert extra == {v: k for v, k in expected.items() if v in tokens}, text
