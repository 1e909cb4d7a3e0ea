"""Text functions, Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions import constants as C

SPACE = r"[ \t\n\r\f\x0B]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though lambdas inside use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _in(x: Column, words) -> Column:
    return x.isin(list(words))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def keyword_tokens(text: Column) -> Column:
    """Lower-cased ASCII words of three characters or more that are no stop words; repeats stay."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~_in(w, C.STOPWORDS))


def sentences(text: Column) -> Column:
    """Split after . ! or ? where white space follows; blanks are dropped."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def letters_beyond_latin(text: Column) -> Column:
    """Share of letters above U+024F."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return F.length(F.regexp_replace(letters, "[\\x{0000}-\\x{024F}]", "")) / F.greatest(F.length(letters), F.lit(1))


def estimate_tokens_by_script(text: Column) -> Column:
    """Characters over 4, or 2 beyond Latin, in proportion; 1 at least unless the text is empty."""
    r = letters_beyond_latin(text)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / (2.0 * r + 4.0 * (1.0 - r))))).cast("long")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the other and half of the Cyrillic characters, each rounded down."""
    cyrillic = F.length(text) - F.length(F.regexp_replace(text, "[\\x{0400}-\\x{04FF}]", ""))
    return (F.floor((F.length(text) - cyrillic) / 4) + F.floor(cyrillic / 2)).cast("long")


def clean_markup(text: Column) -> Column:
    """Without images and tags, links as their text, three newlines or more as two."""
    x = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)|<[^>]+>|\[([^\]]*)\]\([^)]*\)", "$1")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def title_of(markdown: Column, body: Column, default: str = "untitled") -> Column:
    """Title or key of a JSON body, else the first '# ' heading, else the first 80 characters of the first line with text."""
    lines = F.filter(F.transform(F.split(markdown, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    heading = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    some = lambda x: F.when(F.length(x) > 0, x)
    return F.coalesce(
        some(F.get_json_object(body, "$.title")), some(F.get_json_object(body, "$.key")), some(F.trim(F.substring(heading, 3, 1_000_000))),
        some(F.trim(F.substring(F.get(lines, F.lit(0)), 1, 80))), F.lit(default),
    )


def shingles(text: Column, size: int = 3) -> Column:
    """Lower-cased word windows; a shorter text is one shingle, a blank one none."""

    def of(w: Column) -> Column:
        long_ = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(long_)

    return let(words(F.lower(text)), of)


def ticket_keys(text: Column) -> Column:
    """Distinct ticket keys in upper case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(C.TICKET_KEY), F.lit(0)), lambda k: F.upper(k)))


def title_entities(text: Column) -> Column:
    """Names that may stand in titles: runs of two to four capitalised words, and upper-case tokens; distinct without case, first spelling."""
    many = F.filter(F.regexp_extract_all(text, F.lit(r"\b((?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+)\b"), F.lit(1)), lambda x: F.length(x) > 3)
    short = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z0-9]{2,})\b"), F.lit(1)), lambda x: ~_in(x, C.TITLE_STOP) & ~x.rlike(r"^\d+$"))
    return let(F.concat(many, short), lambda every: F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: F.upper(y)), F.upper(x)) == i + 1))


def language(text: Column) -> Column:
    """Russian if three tenths or more of the Latin and Cyrillic letters are Cyrillic, else English."""
    n = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    cyrillic, latin = n("[\\x{0400}-\\x{04FF}]"), n("[A-Za-z]")
    return F.when((cyrillic + latin > 0) & (cyrillic >= 0.3 * (cyrillic + latin)), "Russian").otherwise("English")


def query_profile(text: Column, dated: Column) -> Column:
    """The profile whose rule matches, if exactly one does."""
    flags = {"execution": text.rlike(C.TICKET_KEY) | text.rlike(C.EXECUTION_WORDS), "temporal": dated | text.rlike(C.TEMPORAL_WORDS), "user_file": text.rlike(C.FILE_WORDS), "relationship": text.rlike(C.RELATION_WORDS)}
    total = sum((f.cast("int") for f in flags.values()), F.lit(0))
    name = F.coalesce(*[F.when(f, F.lit(k)) for k, f in flags.items()])
    return F.when(total == 1, name)


def needs_rewrite(text: Column) -> Column:
    """Fewer than five words, or a pronoun."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return (F.size(w) < 5) | F.arrays_overlap(w, F.array(*map(F.lit, C.PRONOUNS)))


def keywords(text: Column, limit: int = 5) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), lambda w: F.lower(w))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~_in(w, C.KEYWORD_STOP))), 1, limit)


def entity_type(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """The fixed type that a free one means; Concept if none."""
    x = F.lower(F.trim(raw))
    known = {**{kind.lower(): kind for kind in C.ENTITY_TYPES}, **(aliases or C.TYPE_ALIASES)}
    out = F.lit("Concept")
    for kind in C.ENTITY_TYPES:
        out = F.when(_in(x, [a for a, k in known.items() if k == kind]), kind).otherwise(out)
    return out


def valid_entity_name(name: Column) -> Column:
    x = F.trim(name)
    sentence = F.size(words(x)) >= 6
    return F.coalesce((F.length(x) >= 2) & (F.length(x) <= 50) & ~sentence & ~x.rlike("^(https?://|/)") & ~(x.contains("/") & (F.length(x) > 30)) & (F.length(x) - F.length(F.replace(x, F.lit("_"), F.lit(""))) <= 3), F.lit(False))


def role_not_person(name: Column, kind: Column) -> Column:
    return (kind == "Person") & _in(F.lower(F.trim(name)), C.ROLE_WORDS)


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character."""

    def of(chars: Column) -> Column:
        p = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.size(chars))
        return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log2(x))

    return let(F.split(token, ""), of)


def random_looking_token(text: Column) -> Column:
    """Whether a token of 24 characters or more mixes two kinds of characters and has 3.5 bits each."""
    kinds = lambda t: sum((t.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[_+/=-]")), F.lit(0))
    return F.exists(F.regexp_extract_all(text, F.lit(C.LONG_TOKEN), F.lit(0)), lambda t: (kinds(t) >= 2) & (entropy(t) >= 3.5))


def unsafe(text: Column) -> Column:
    """Credentials, random-looking tokens, or text that claims to instruct the system."""
    told = text.rlike(C.ROLE_HEADER) | text.rlike(C.ROLE_CLAIM) | text.rlike(C.PROTECTED_DISCLOSURE) | (text.rlike(C.PRECEDENCE) & text.rlike(C.INSTRUCTION_TARGET))
    return text.rlike(C.LABELLED_CREDENTIAL) | text.rlike(C.KNOWN_CREDENTIAL) | told | random_looking_token(text)


def candidate_status(text: Column, explicit: Column) -> Column:
    """Null where a candidate is rejected: blank, chatter or unsafe; else active if explicit, candidate if not."""
    bare = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when((bare == "") | _in(bare, C.CHATTER) | unsafe(text), F.lit(None).cast("string")).when(explicit, "active").otherwise("candidate")


def intent(text: Column) -> Column:
    x = F.lower(F.trim(text))
    any_ = lambda words_, f: F.exists(F.array(*map(F.lit, words_)), f)
    return (
        F.when(x.rlike("^[/!]"), "command")
        .when(_in(x, C.GREETINGS) | _in(F.regexp_replace(x, "!+$", ""), C.GREETINGS), "greeting")
        .when(any_(C.SMALLTALK, lambda w: F.startswith(x, w)), "smalltalk")
        .when(any_(C.ACTIONS, lambda w: F.contains(x, w)), "action")
        .otherwise("search")
    )


def with_sources(answer: Column, results: Column) -> Column:
    """answer followed by the sources of results (title, url, source_type), each title once, in the order of appearance; as it is without any."""
    titled = F.filter(results, lambda r: F.coalesce(r["title"], F.lit("")) != "")
    titles = F.transform(titled, lambda r: r["title"])
    first = F.filter(titled, lambda r, i: F.array_position(titles, r["title"]) == i + 1)
    icon = lambda kind: F.coalesce(*[F.when(kind == k, v) for k, v in C.SOURCE_ICONS.items()], F.lit(C.OTHER_ICON))
    line = lambda r: F.concat(icon(r["source_type"]), F.lit(" "), r["title"], F.when(F.coalesce(r["url"], F.lit("")) != "", F.concat(F.lit(" — "), r["url"])).otherwise(""))
    return F.when(F.size(first) > 0, F.concat(answer, F.lit(f"\n\n{C.SOURCES_HEAD}\n"), F.array_join(F.transform(first, line), "\n"))).otherwise(answer)


def slug(text: Column, most: int = 80) -> Column:
    """A path segment of letters, digits and . _ -; empty ones are named by a digest."""
    x = F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.substring(F.when(x == "", F.concat(F.lit("item-"), F.substring(F.sha1(text), 1, 8))).otherwise(x), 1, most)


def row_text(columns: list[str], number: Column | None = None, most: int = 500) -> Column:
    """'Row N: column: value, ...' of the columns that are not blank, values cut at most characters."""
    value = lambda c: F.trim(F.col(c).cast("string"))
    pair = lambda c: F.when(F.length(value(c)) > 0, F.concat(F.lit(f"{c}: "), F.when(F.length(value(c)) > most, F.concat(F.substring(value(c), 1, most), F.lit("..."))).otherwise(value(c))))
    body = F.concat_ws(", ", *[pair(c) for c in columns])
    return body if number is None else F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), body)


def filing_metadata(filename: Column) -> Column:
    """company, fiscal_year and doc_type of COMPANY_YEAR[Qn]_TYPE[_more] names, null if the name is no such."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    pattern = r"^([A-Z0-9][A-Z0-9&]+?)_(\d{4})(?:Q\d)?_([A-Za-z0-9_-]+)"
    g = lambda k: F.regexp_extract(stem, pattern, k)
    return F.when(stem.rlike(pattern), F.struct(g(1).alias("company"), g(2).alias("fiscal_year"), F.upper(F.split(g(3), "_")[0]).alias("doc_type")))


def ungrounded_keys(answer: Column, sources: Column) -> Column:
    """Ticket keys in an answer that its sources do not have, sorted."""
    return F.array_sort(F.array_except(ticket_keys(answer), ticket_keys(sources)))


def redacted(text: Column) -> Column:
    """Labelled credentials, key prefixes and addresses as ***."""
    x = F.regexp_replace(text, C.KNOWN_CREDENTIAL, "***")
    x = F.regexp_replace(x, r"(?i)\b(token|password|passwd|secret|api_key)\b(\s*[=:]\s*)\S+", "$1$2***")
    return F.regexp_replace(x, r"://[^/\s:@]+:[^/\s@]+@", "://***@")


def doc_label(*parts: Column) -> Column:
    """Parts joined by ':' without characters that cannot be encoded."""
    return F.regexp_replace(F.concat_ws(":", *parts), "[\\x{D800}-\\x{DFFF}]", "")


def html_text(html: Column) -> Column:
    """Readable text of a page: JSON bodies opened, scripts and styles dropped, headings and items marked, tags stripped, common entities decoded."""
    some = lambda p: F.when(F.length(F.get_json_object(html, p)) > 0, F.get_json_object(html, p))
    inner = F.coalesce(some("$.body.storage.value"), some("$.body.view.value"), some("$.title"), html)
    x = F.regexp_replace(inner, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    for k in range(1, 7):
        x = F.regexp_replace(x, rf"(?i)<h{k}\b[^>]*>", "\n" + "#" * k + " ")
    x = F.regexp_replace(x, r"(?i)<li\b[^>]*>", "\n* ")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/h[1-6]|/tr|/ul|/ol|/table)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(x, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))
