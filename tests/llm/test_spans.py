import random
import re

from corvane.llm import licenses, pii
from tests.llm.support import SCHEMA, odd_documents, odd_rows, prose

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    rows = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(FORMS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return sorted(rows)


def test_base_spans_are_those_of_the_forms(spark):
    rng = random.Random(9)
    alphabet = ["@", ".", "-", "_", "+", " ", "(", ")", "4", "11", "255", "256", "a", "Z", "é", "\U0001f600", "\n", "4111111111111111", "a@b.c", "+491234567890", "1.2.3.4"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["1 " * 30_000, "1." * 20_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "+" + "1 " * 9000, "a" * 60_000, "00255.1.1.1 5@5.5 x"]
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)] + odd_rows()
    want = sorted(str((r[0], base(r[1]))) for r in rows)
    found = pii.find(odd_documents(spark, rows)).collect()
    assert sorted(str((r.doc_id, [tuple(s) for s in r.base])) for r in found) == want
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.found)) for r in found)


def test_contexts_find_what_has_no_form(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        number = f"+49 30 {rng.randrange(10**6, 10**7)}"
        rows.append((i, f"{prose(rng, 20)} my number is {number} thanks {prose(rng, 9)}", None, None, None, None, None, None))
    hidden = {100 + i: f"0{rng.randrange(10**5, 10**6)}/{i:02d}" for i in range(5)}
    rows += [(d, f"{prose(rng, 9)} my number is {v} thanks {prose(rng, 5)}", None, None, None, None, None, None) for d, v in hidden.items()]
    rows.append((200, "the year is 123456 anyway", None, None, None, None, None, None))
    docs = odd_documents(spark, rows)
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(docs).collect()}
    texts = {r[0]: r[1] for r in rows}
    for d, v in hidden.items():
        at = texts[d].index(v)
        assert found[d] == [(at, list(FORMS).index("phone"), at + len(v))]
    assert found[200] == [] and all(len(found[i]) == 1 for i in range(40))
    clean = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert all(hidden[d] not in clean[d] and "number is <PHONE> thanks" in clean[d] for d in hidden) and clean[200] == texts[200]


def test_found_values_lead_to_patterns_without_seeds(spark):
    """Seeds give a pattern, its other values a second one, and that one values that no seed's context has."""
    rng = random.Random(4)
    phones = [f"+49 30 {rng.randrange(10**6, 10**7)}" for _ in range(40)]
    first, second = ([f"0{rng.randrange(10**5, 10**6)}/{i:02d}" for i in range(at, at + n)] for at, n in ((10, 9), (30, 2)))
    texts = [f"{prose(rng, 9)} my number is {v} thanks {prose(rng, 9)}" for v in phones + first]
    texts += [f"{prose(rng, 9)} filed under ticket {v} today {prose(rng, 9)}" for v in first + second]
    found = pii.find(odd_documents(spark, [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)])).collect()
    shown = [[texts[r.doc_id][s.start : s.end] for s in r.found] for r in sorted(found, key=lambda r: r.doc_id)]
    assert shown == [[v] for v in phones + first + first + second]


def test_masking_odd_rows(spark):
    docs = odd_documents(spark)
    clean = pii.masked(docs)
    assert clean.columns == docs.columns
    want = []
    for r in odd_rows():
        text, at, out = r[1], 0, []
        for start, k, end in base(r[1]):
            if start >= at:
                out += [text[at:start], f"<{list(FORMS)[k].upper()}>"]
            at = max(at, end)
        want.append((r[0], "".join([*out, text[at:]]) if out else text))
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(map(str, want))
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find(empty).collect() == [] and pii.masked(empty).collect() == []


def test_patience_alignment():
    a, b = "x the quick brown fox y z".split(), "the quick red fox".split()
    assert licenses.patience(a, b) == [(1, 0), (2, 1), (4, 3)]
    assert licenses.patience([], b) == [] == licenses.patience(a, [])
    # Repeated words are aligned once unique ones around them have cut the gaps.
    assert licenses.patience("u a a v a w".split(), "u a v a w".split()) == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4)]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_notices_in_documents(spark):
    rng = random.Random(2)
    rows, want = [], []
    for i, (name, notice) in enumerate(licenses.NOTICES.items()):
        head = prose(rng, 50)
        shown = notice if i % 2 else notice.upper().replace(" ", "\n * ")
        rows.append((i, f"{head}\n{shown}\n{prose(rng, 500)}", None, None, None, None, None, None))
        want.append((i, name, 1.0))
    header = licenses.NOTICES["MIT-permission"].replace("free of charge, ", "")
    rows.append((50, f"{prose(rng, 30)} {header} {prose(rng, 30)} {licenses.NOTICES['GPL-3.0']}", None, None, None, None, None, None))
    found = licenses.scan(odd_documents(spark, rows + odd_rows())).collect()
    assert sorted((r.doc_id, r.license, r.coverage) for r in found if r.doc_id < 50) == sorted(want)
    assert [r.license for r in sorted((r for r in found if r.doc_id == 50), key=lambda r: r.start)] == ["MIT-permission", "GPL-3.0"]
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        shown = licenses.words_of(texts[r.doc_id][r.start : r.end])
        assert shown[0] == licenses.words_of(licenses.NOTICES[r.license])[0] and r.matched >= licenses.COVERAGE * len(licenses.words_of(licenses.NOTICES[r.license]))
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_notices_are_rows_each():
    templates = {name: licenses.words_of(text) for name, text in licenses.NOTICES.items()}
    reach, telling = max(map(len, templates.values())), {w for t in templates.values() for w in t if len(w) >= 5}
    rng = random.Random(6)
    for name in ("all-rights-reserved", "MIT-permission", "Apache-2.0-header", "GPL-3.0"):
        for apart in range(41):
            for lacking in (False, True):
                copies = [licenses.words_of(licenses.NOTICES[name]) for _ in range(3)]
                if lacking and len(copies[0]) > 20:
                    del copies[1][7], copies[2][12], copies[2][4]
                gaps = [[f"Foo{rng.randrange(99)}" for _ in range(n)] for n in (30, apart, apart, 30)]
                text = " ".join(w for part in zip(gaps, [*copies, []]) for x in part for w in x)
                found = licenses.notices_in(text, templates, telling, reach, licenses.COVERAGE)
                shown = [licenses.words_of(text[start:end]) for _, start, end, _, _ in found]
                assert [f[0] for f in found] == [name] * 3 and shown == copies, (name, apart, lacking, found)
