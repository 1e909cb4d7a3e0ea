"""Secret scans: pattern kinds plus sliding-window Shannon entropy, in SQL functions alone.

Defined results: a null text is empty; empty texts, and texts without a secret, give zero
counts and an empty span list; repeated rows are scanned one by one; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base kinds: name, pattern, group that is measured, its least length.
BASE_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
KINDS = ["assign", "access", "hex", "entropy"]
#: What may stand in a candidate string; it starts where no such character precedes.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_LENGTH = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
#: Character classes of candidates: name, pattern of the whole string, window, least entropy in bits.
#: The first that fits counts. Words and names reach these entropies too and are told apart by WORD_SHARE.
CLASSES = [
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 20, 3.0),
    ("alnum", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", 20, 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_=-]+$", 24, 3.9),
    ("base32", r"^(?=.*[2-7][A-Z]+[2-7])[A-Z2-7]+=*$", 16, 3.2),
    ("lower", r"^(?=.*[0-9][a-z]+[0-9])[0-9a-z]+$", 20, 3.4),
    ("upper", r"^(?=.*[0-9][A-Z]+[0-9])[0-9A-Z]+$", 20, 3.4),
    ("lower_symbols", r"^(?=.*[0-9][a-z]+[0-9])[0-9a-z+/_=-]+$", 24, 3.85),
    ("upper_symbols", r"^(?=.*[0-9][A-Z]+[0-9])[0-9A-Z+/_=-]+$", 24, 3.85),
    ("lower_letters", r"^(?=.*[a-z])[0-9a-z]+$", 24, 3.5),
    ("upper_letters", r"^(?=.*[A-Z])[0-9A-Z]+$", 24, 3.5),
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", 24, 3.7),
    ("letters_symbols", r"^(?=.*[A-Za-z])[0-9A-Za-z+/_=-]+$", 24, 4.25),
]
#: Strings that look random and are no secrets: UUIDs, integrity digests, samples.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|384|512)-|example|x{6}|(.)\2{7}"
#: Parts of a name, as case and digits divide it; a string is one of words if parts of three letters or more make up
#: WORD_SHARE of it and COMMON_SHARE of their pairs of letters are common ones. Of random pairs a seventh is common.
PARTS, WORD_SHARE, COMMON_SHARE = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", 0.7, 0.35
# The hundred most frequent pairs of letters of English text, the most frequent first.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su"
).split()
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of a pattern's matches: gaps from split() and matches from regexp_extract_all() alternate."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    items = F.zip_with(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"))),
        measured,
        lambda x, m: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), (F.length(m) >= least).alias("ok")),
    )
    found = F.aggregate(
        F.filter(items, lambda x: x["n"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(
                x["ok"],
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["n"]).alias("stop")))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _plogp(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _best_window(token: Column, window: Column) -> Column:
    """Highest entropy of any window. The counts and the sum of c*log2(c) move with the window:
    one character comes in, one goes out, and only their two terms change."""
    chars = F.split(token, "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def step(a: Column, i: Column) -> Column:
        come = F.get(a["codes"], i)
        go = F.when(i >= a["w"], F.get(a["codes"], i - a["w"])).otherwise(F.lit(-1))
        left = F.when(go >= 0, F.get(a["n"], go)).otherwise(F.lit(0))
        s = a["s"] - _plogp(left) + F.when(go >= 0, _plogp(left - 1)).otherwise(F.lit(0.0))
        had = F.get(a["n"], come) - F.when(go == come, F.lit(1)).otherwise(F.lit(0))
        s = s - _plogp(had) + _plogp(had + 1)
        n = F.transform(a["n"], lambda c, k: c + F.when(k == come, F.lit(1)).otherwise(F.lit(0)) - F.when(k == go, F.lit(1)).otherwise(F.lit(0)))
        h = F.when(i + 1 >= a["w"], F.log2(a["w"].cast("double")) - s / a["w"]).otherwise(F.lit(0.0))
        return F.struct(a["codes"].alias("codes"), a["w"].alias("w"), n.alias("n"), s.alias("s"), F.greatest(a["best"], h).alias("best"))

    start = F.struct(codes.alias("codes"), window.alias("w"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda a: a["best"])


def is_words(token: Column) -> Column:
    """Whether a string is made of words, run together or divided by case, digits or signs."""
    parts = F.regexp_extract_all(token, F.lit(PARTS), F.lit(0))
    words = F.filter(parts, lambda p: (F.length(p) >= 3) & p.rlike("^[A-Za-z]"))
    length = lambda x: F.aggregate(x, F.lit(0), lambda a, p: a + F.length(p))
    common = lambda p: F.size(F.filter(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(F.lower(p), i, 2).isin(PAIRS)))
    pairs = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("common")), lambda a, p: F.struct((a["n"] + F.length(p) - 1).alias("n"), (a["common"] + common(p)).alias("common")))
    return (F.size(words) > 0) & (length(words) >= WORD_SHARE * length(parts)) & (pairs["common"] >= COMMON_SHARE * pairs["n"])


def _is_random(token: Column) -> Column:
    window, least = F.lit(None).cast("int"), F.lit(None).cast("double")
    for _, pattern, w, bits in reversed(CLASSES):
        window = F.when(token.rlike(pattern), F.lit(w)).otherwise(window)
        least = F.when(token.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(F.coalesce(F.length(token) >= window, F.lit(False)), ~token.rlike(ALLOWED) & ~is_words(token) & (_best_window(token, window) >= least)).otherwise(F.lit(False))


def find_spans(text: Column, least_length: int = LEAST_LENGTH) -> tuple[Column, Column]:
    """(base spans, text-derived candidate spans), both array<struct<start,kind,stop>> in order of start, kind."""
    base = F.concat(*[_matches(text, p, g, n, k) for k, (_, p, g, n) in enumerate(BASE_KINDS)])
    return F.array_sort(base), _matches(text, CANDIDATE % least_length, 0, least_length, KINDS.index("entropy"))


def scan(docs: DataFrame, text_column: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text_, base_spans and spans (base ones and entropy ones that overlap none of them)."""
    base, candidates = find_spans(F.col("text_"))
    step = docs.select(*keys, F.coalesce(F.col(text_column), F.lit("")).alias("text_")).select(*keys, "text_", base.alias("base_spans"), candidates.alias("candidates_"))
    new = F.filter(
        "candidates_",
        lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])) & _is_random(F.substring(F.col("text_"), c["start"] + 1, c["stop"] - c["start"])),
    )
    return step.withColumn("spans", F.when(F.size("candidates_") > 0, F.array_sort(F.concat("base_spans", new))).otherwise(F.col("base_spans"))).drop("candidates_")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each row."""
    found = scan(docs)
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count("base_spans", k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE_KINDS)],
        F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        count("spans", 3).alias("n_entropy"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of a secret replaced by [kind]; overlapping spans become one. Other rows are as they were."""
    found = scan(docs.select(F.struct("*").alias("row_"), "text"), keys=("row_",))
    merged = F.aggregate(
        "spans",
        F.array().cast(_SPANS),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.element_at(a, -1)["stop"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.element_at(a, -1)["kind"].alias("kind"), F.greatest(F.element_at(a, -1)["stop"], s["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    kind = lambda s: F.get(F.array(*[F.lit(f"[{k}]") for k in KINDS]), s["kind"])
    clean = F.aggregate(
        merged,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(F.col("text_"), a["at"] + 1, s["start"] - a["at"]), kind(s)).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col("text_"), a["at"] + 1, F.length("text_"))),
    )
    text = F.when(F.col("row_.text").isNull(), F.lit(None)).when(F.size("spans") == 0, F.col("text_")).otherwise(clean)
    out = found.select("row_", text.alias("clean_"))
    new = {"text": F.col("clean_"), "n_chars": F.when(F.col("clean_") == F.col("row_.text"), F.col("row_")["n_chars"]).otherwise(F.length("clean_")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col("row_")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
