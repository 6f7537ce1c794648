import hashlib
import re

from lamina.llm import secret_scan as ss

from .conftest import DOCS


def plain_base(text):
    text = text or ""
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def parts(make, text, **how):
    (row,) = ss.scan_secrets(make([(1, text, None, None, None, None, None)], DOCS), **how).collect()
    return [(p["kind"], p["start"], p["end"]) for p in row["parts"] if p["base"]], [(p["kind"], text[p["start"]:p["end"]]) for p in row["parts"] if not p["base"]]


TEXTS = [
    None, "", "token = abcdef", "token = abc", 'PassWord": "x.y-z=1"', "toKen=a token=bcdefgh", "api_key:0123456789abcdef0123456789", "ſecret = abcdefg",
    "toKen = abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "9" * 13, "é" * 9 + " " + "0123456789abcdef" * 3, "x" + "a" * 23 + "G", "secret=secret=abcdef",
]


def test_base_spans_follow_the_definition(make):
    found = ss.scan_secrets(make([(n, t, None, None, None, None, None) for n, t in enumerate(TEXTS)], DOCS)).collect()
    assert {r["id"]: [(p["kind"], p["start"], p["end"]) for p in r["parts"] if p["base"]] for r in found} == {n: plain_base(t) for n, t in enumerate(TEXTS)}


def test_weak_parts_need_their_complements(make):
    opaque = "aB3" * 12
    assert parts(make, f"a mixed {opaque} alone")[1] == []
    assert parts(make, "see https://host.example/x for more")[1] == []
    assert parts(make, "login: somebody")[1] == []
    assert parts(make, f"login: somebody and {opaque}")[1] == [("identity", "login: somebody"), ("opaque", opaque)]
    assert parts(make, f"{opaque} at https://host.example/x")[1] == [("opaque", opaque)]
    assert parts(make, f"login: me1 {opaque} https://host.example/x")[1] == [("identity", "login: me1"), ("opaque", opaque), ("endpoint", "https://host.example/x")]
    access = "AKIA" + "B" * 16
    assert parts(make, f"{access} then {opaque}") == ([("access", 0, 20)], [("opaque", opaque)])
    # Another paragraph, or too far away, is another scope.
    assert parts(make, f"{access}\n \n{opaque}")[1] == []
    assert parts(make, f"{access} {'word ' * 50}{opaque}")[1] == [] and parts(make, f"{access} {'word ' * 50}{opaque}", reach=300)[1] != []


def test_links_equal_all_pairs():
    import random

    forms, rng = ss._compiled(), random.Random(5)
    tokens = ["aB3" * 12, "AKIA" + "C" * 16, "login=meme", "https://a.example/b", "secret=abcdefgh", "word", "\n\n", "f" * 30]
    for _ in range(200):
        text = " ".join(rng.choice(tokens) for _ in range(rng.randrange(1, 12)))
        strong = ss.strong_parts(text, forms)
        weak = [(*m.span(), kind) for kind in ss.NEEDS for m in forms[kind].finditer(text)]
        weak = [w for w in weak if not any(s < w[1] and w[0] < e for s, e, _ in strong)]
        scope = lambda p, text=text: len(re.findall(r"\n[ \t\r]*\n", text[:p[0] + 1]))
        near = lambda p, q: scope(p) == scope(q) and q[0] <= p[1] + 60 and p[0] <= q[1] + 60
        wanted = [p for p in weak if all(any(near(p, q) and ss.ROLE[q[2]] in roles for q in strong + weak) for roles in ss.NEEDS[p[2]])]
        assert sorted(ss.linked_parts(text, strong, forms, 60)) == sorted(wanted)


def test_query_equals_brute_force(spark, sf_dir):
    import __spark_entry__ as entry

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = entry.queries()["op5_secrets"](spark, sf_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        base = plain_base(docs[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[0] == k for b in base) for k in ("assign", "access", "hex"))
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))


def test_redaction(make):
    rows = [(1, "a token = abcdefgh b", "en", "s", 20, "i", 1), (1, "a token = abcdefgh b", "en", "s", 20, "i", 1), (2, None, None, None, None, None, None),
            (3, "clean", "en", "s", 99, "i", 1), (4, "token=" + "0" * 40, "en", "s", 46, "i", 1)]
    docs = make(rows, DOCS)
    found = ss.redact(docs)
    assert found.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in found.collect()), key=str) == sorted(
        [(1, "a [assign] b", 12), (1, "a [assign] b", 12), (2, None, None), (3, "clean", 99), (4, "[assign]", 8)], key=str)
    assert ss.redact(make([], DOCS)).collect() == [] and ss.scan_secrets(make([], DOCS)).collect() == []


def test_linked_parts_keep_clear_of_long_strong_ones(make):
    """Many short strong parts inside a long one do not hide it."""
    runs = ".".join(["0123456789abcdef01234567"] * 4)
    text = f"login=someone token={runs}.aB3" + "xY7" * 12
    base, linked = parts(make, text)
    assert [p[0] for p in base] == ["assign", *["hex"] * 4] and max(p[2] for p in base) == len(text)
    assert [kind for kind, _ in linked] == ["identity"]


def test_a_very_long_text(make):
    text = "words and more words, none of them secret. " * 40_000 + "token = abcdef123"
    assert [p[0] for p in parts(make, text)[0]] == ["assign"]
