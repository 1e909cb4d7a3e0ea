"""Line dedup, embedding whitening and fill-in-the-middle: SQL, brute force, round trips and edge rows."""

import hashlib
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import infill, repeated_lines, whitening
from lodestream.llm.common import read_table
from lodestream.llm.queries import ORACLE_SQL, QUERIES

SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_fill_in_middle"])
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    rel = c.execute(ORACLE_SQL[name])
    assert [d[0] for d in rel.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def kept_by_hand(rows, min_chars=20, min_documents=3):
    """(id, lines, dropped, kept text) of rows (id, text), in their order."""
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACES).translate(lower)
    holders = {}
    for i, parts in lines:
        for x in parts:
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    last = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= min_documents}
    out = []
    for i, parts in lines:
        kept = [x for x in parts if key(x) not in last or last[key(x)] == i]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


LONG = "A line that many documents have"
LINE_ROWS = [
    (1, None), (2, ""), (3, "\n"), (4, f"{LONG}\nown one\n  {LONG.upper()}\t\nend"), (5, LONG), (6, f"x\n\n{LONG}\r"), (6, f"x\n\n{LONG}\r"), (7, f"{LONG}\n{LONG}"), (8, "short common line\nx" * 3), (9, "short common line"), (10, "short common line"),
    (None, f"{LONG}\nof no id"), (None, "second of no id, long enough"), (11, "ÄÖÜ äöü ÄÖÜ äöü 12345"), (12, "äöü äöü ÄÖÜ äöü 12345"), (13, "ÄÖÜ äöü ÄÖÜ äöü 12345"), (14, "ÄÖÜ äöü ÄÖÜ äöü 12345\n"),
    (15, "　ideographic space stays　"), (16, "ideographic space stays"), (17, "ideographic space stays"), (18, "123456789 123456789 "), (19, "123456789 123456789 "), (20, "123456789 123456789 "), (21, "123456789 1234567890"), (22, "123456789 1234567890"), (23, " 123456789 1234567890\x0b"),
    (-5, f"{LONG}"), (30, "\x00 a line with a zero byte"), (31, "\x00 a line with a zero byte"), (32, "\x00 a line with a zero byte\x00"),
]


def test_line_rows_by_hand(spark):
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in LINE_ROWS], "doc_id long, text string, gone string, kept string")
    got = sorted(map(str, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in repeated_lines.digest(docs).collect())))
    by_hand = kept_by_hand(LINE_ROWS)
    assert got == sorted(str((i, n, d, sha(t))) for i, n, d, t in by_hand)
    texts = sorted((str(r.doc_id), r.text or "", r.gone) for r in repeated_lines.dedup(docs).collect())
    assert texts == sorted((str(i), t, "own") for i, _, _, t in by_hand) and repeated_lines.dedup(docs).columns == docs.columns
    one = repeated_lines.digest(docs.limit(0))
    assert one.count() == 0 and one.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_random_lines_by_hand(spark):
    """Random texts from a small stock of lines, at several thresholds; one line is in a third of all documents."""
    rng = random.Random(4)
    stock = [f"line number {k} of a small stock" for k in range(60)] + ["short", "", " "]
    rows = [(rng.randrange(400), "\n".join([*(["the line of a third of them"] if k % 3 == 0 else []), *rng.choices(stock, k=rng.randrange(6))])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least, many in ((20, 3), (1, 2), (25, 50)):
        got = sorted((r.doc_id, r.text) for r in repeated_lines.dedup(docs, least, many).collect())
        assert got == sorted((i, t) for i, _, _, t in kept_by_hand(rows, least, many))


def test_very_long_text_of_lines(spark):
    """A text of 200,000 lines, most of which go, is put together in time linear in its lines."""
    lines = [f"line number {k} of a long text" for k in range(100_000)]
    docs = spark.createDataFrame([(k, "\n".join(lines + [f"only in {k}, as it was"] * 100_000)) for k in range(3)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeated_lines.digest(docs).collect()}
    assert [got[k].n_dropped for k in range(3)] == [100_000, 100_000, 0]
    assert got[1].kept_sha256 == sha("\n".join(["only in 1, as it was"] * 100_000))


def test_infill_rows(spark):
    """Every form appears, texts come back, and what cannot be taken apart stays plain."""
    rng = random.Random(2)
    letters = "aé😀\n\r <PSM>\x00 "
    rows = [(k, "".join(rng.choices(letters, k=rng.randrange(30)))) for k in range(600)] + [(None, "no id at all"), (5, None), (5, ""), (6, "has <S> in it"), (7, "x<S"), (7, "x<S"), (8, "😀"), (9, "y" * 1_500_000)]
    docs = spark.createDataFrame([(i, t, "own", 5) for i, t in rows], "doc_id long, text string, form string, units int")
    got = infill.transform(docs)
    assert got.columns == ["doc_id", "units", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    for r in back:
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        t, n = r.text, len(r.text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("plain", None, None, t)
        elif h4 % 100 < 20:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
        else:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")
        assert r.n == n
    assert infill.digest(docs.limit(0)).count() == 0


def by_hand(vectors):
    """Exact mean and deviations, and the eigenpairs of the covariance, of float32 vectors."""
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), [sum(map(int, c)) for c in x.T]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(n * int(a) - b, n)) for a, b in zip(row, s)] for row in x])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, value[::-1], vector[:, ::-1]


def check(got, ids, vectors, k, rel=1e-7):
    deviation, centred, value, vector = by_hand(vectors)
    at = {}
    for r in got:
        at.setdefault(r.component, []).append(r)
    assert sorted(at) == list(range(1, k + 1))
    for c in range(1, k + 1):
        rows = sorted(at[c], key=lambda r: (str(r.vec_id), r.deviation, r.whitened))
        own = centred @ vector[:, c - 1] / np.sqrt(value[c - 1])
        sign = min((1, -1), key=lambda g: np.abs(np.sort([r.whitened for r in rows]) - np.sort(g * own)).max())
        expected = sorted(zip(map(str, ids), deviation, sign * own))
        assert [(str(r.vec_id), r.deviation) for r in rows] == [e[:2] for e in expected]
        assert [r.whitened for r in rows] == pytest.approx([e[2] for e in expected], rel=rel, abs=rel)
        assert {r.n for r in rows} == {len(vectors)} and rows[0].explained == pytest.approx(value[c - 1] / value.sum(), rel=1e-9)
        assert rows[0].identity_error < 1e-9 and all(int(r.deviation_exact) == r.deviation for r in rows)


def test_whitening_of_the_table(spark, sf):
    rows = read_table(spark, sf, "embeddings").collect()
    check(whitening.whiten(read_table(spark, sf, "embeddings")).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 8)


def test_power_passes_suffice_where_values_fall(spark):
    """A steep spectrum settles within the passes; a flat one is completed to full dimension; both equal the whole eigensystem."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for scale, full in ((30.0 * 0.3 ** np.arange(40) + 1e-3, False), (np.linspace(2, 1, 40), True)):
        x = (rng.standard_normal((900, 40)) * scale @ turn.T).astype(np.float32)
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
        rows, dim = whitening.usable(df)
        rows._lodestream_dim = dim
        cov = whitening.Covariance(rows, whitening.moments(rows, dim))
        widths = []
        times = cov.times
        cov.times = lambda q: widths.append(q.shape[1]) or times(q)
        whitening.components(cov)
        assert (widths[-1] == 24) == full and widths[0] == 16 and len(widths) <= 8
        check(whitening.whiten(df).collect(), range(900), x, 8, rel=1e-6)


def test_blocks_of_columns_change_nothing(spark, sf, monkeypatch):
    df = read_table(spark, sf, "embeddings")
    plain = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 64 * 5)
    for r in whitening.whiten(df).collect():
        p = plain[r.vec_id, r.component]
        assert abs(r.whitened) == pytest.approx(abs(p.whitened), abs=1e-8) and r.explained == pytest.approx(p.explained, rel=1e-10)


def test_whitening_edge_rows(spark):
    """Unusable rows go, others count; fewer dimensions than components; none for one vector or none."""
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 2.0]), (2, [0.5, -1.0, 2.0]), (2, [0.5, -1.0, 2.0]), (None, [3.0, 0.25, 2.0]), (4, [0.1, 0.2, 2.0])]
    bad = [(5, None), (6, []), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [-inf, 0.0, 0.0]), (10, [None, 1.0, 1.0]), (11, [1.0, 2.0]), (12, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "own", 3) for i, v in good + bad], "vec_id long, embedding array<float>, cell string, n int")
    check(whitening.whiten(df).collect(), [i for i, _ in good], [v for _, v in good], 2)
    columns = whitening.whiten(df).columns
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 2"), df.where("vec_id = 7")):
        got = whitening.whiten(none)
        assert got.count() == 0 and got.columns == columns


def test_deviations_are_exact():
    """Whole numbers that leave 64 bits on the way, and results that do."""
    rng = np.random.default_rng(1)
    for size, n in ((1_000, 500), (5_000, 4_000_000), (2**30, 1_000_000_000), (2**40, 10**12)):
        u, rest = rng.integers(-size, size, (20, 7)), rng.integers(0, n, 7)
        assert whitening._deviations(u, rest, n) == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest)) for row in u]


WORDS = (
    "user config service manager factory handler request response http client server data base table index query parse stream reader writer buffer cache token session account profile payment invoice "
    "order customer product category image upload file path name value list array number date time zone format error message event listener controller view model template render button window layout theme color style"
).split()
NAMES = {
    "CamelCase": lambda r: "".join(r.choice(WORDS).capitalize() for _ in range(5)), "camelCase with digits": lambda r: r.choice(WORDS) + "".join(r.choice(WORDS).capitalize() + r.choice(["", "2", "64", "256"]) for _ in range(4)),
    "run together": lambda r: "".join(r.choice(WORDS) for _ in range(5)), "snake": lambda r: "_".join(r.choice(WORDS) for _ in range(5)), "CONSTANT": lambda r: "_".join(r.choice(WORDS).upper() for _ in range(5)),
    "path": lambda r: "/".join(r.choice(WORDS).capitalize() + r.choice(WORDS) for _ in range(4)), "kebab": lambda r: "-".join(r.choice(WORDS) for _ in range(5)),
}
LOWER_, UPPER_, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabet, length and the share that is found at least; base32 of 16 characters often has no two digits apart.
RANDOM = {
    "hex 32": (DIGITS + "ABCDEF", 32, 0.95), "base64 24": (UPPER_ + LOWER_ + DIGITS + "+/", 24, 0.9), "base64 40": (UPPER_ + LOWER_ + DIGITS + "+/", 40, 0.95), "base62 20": (UPPER_ + LOWER_ + DIGITS, 20, 0.9), "base62 32": (UPPER_ + LOWER_ + DIGITS, 32, 0.95),
    "base36 25": (LOWER_ + DIGITS, 25, 0.95), "base32 16": (UPPER_ + "234567", 16, 0.6), "base32 32": (UPPER_ + "234567", 32, 0.95), "mixed letters 24": (UPPER_ + LOWER_, 24, 0.9), "mixed letters 32": (UPPER_ + LOWER_, 32, 0.95), "lower letters 24": (LOWER_, 24, 0.88), "lower letters 32": (LOWER_, 32, 0.95),
}


def test_names_are_no_secrets_and_random_strings_are(spark):
    """Of 200 strings each: names of five words are hit in 0.02 or less, random ones in their class's share or more."""
    from lodestream.llm import secrets

    rng = random.Random(11)
    kinds = [(k, "".join(rng.choice(a) for _ in range(n))) for k, (a, n, _) in RANDOM.items() for _ in range(200)] + [(k, make(rng)) for k, make in NAMES.items() for _ in range(200)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, (_, t) in enumerate(kinds)], "doc_id long, text string")
    hits = {k: 0 for k, _ in kinds}
    for r in secrets.digest(docs).collect():
        hits[kinds[r.doc_id][0]] += bool(r.spans)
    assert {k: n for k, n in hits.items() if k in NAMES and n > 4} == {}
    assert {k: n / 200 for k, n in hits.items() if k in RANDOM and n < 200 * RANDOM[k][2]} == {}


@pytest.mark.parametrize("length", [8, 15, 25, 40])
def test_passages_of_any_sentence_length(spark, length):
    """Passages of 60 words that stand anywhere inside long sentences of other documents are cut there, and hardly anything else is."""
    from lodestream.llm import lines

    rng = random.Random(length)
    stock = ["".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rng.randint(2, 11))) for _ in range(4_000)]

    def prose(n):
        return [w + ("." if k % length == length - 1 else "") for k, w in enumerate(rng.choices(stock, k=n))]

    texts = [prose(400) for _ in range(100)]
    copies = []
    for t in texts:
        a = rng.randrange(300)
        copies.append(prose(150 + rng.randrange(20)) + t[a : a + 60] + prose(150))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts + copies + [prose(400) for _ in range(100)])], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.digest(docs).collect()}
    assert sum(got[k].n_removed > 0 for k in range(100, 200)) >= 95
    assert sum(got[k].n_removed > 0 for k in [*range(100), *range(200, 300)]) <= 2
