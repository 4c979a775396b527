"""Column functions on paths, names and texts; all but ``token_estimate``, ``words`` and ``matches`` stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.names import ENTRY_NAMES, PLACEHOLDERS
from corpusmill.functions.udf import arrow

#: Text that a secret is replaced by.
MASK = "[REDACTED]"


def col(c: Column | str) -> Column:
    """A column from its name or itself."""
    return F.col(c) if isinstance(c, str) else c


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Whether one of the words occurs in the text; words are tried one by one, as a plain search is faster than a regex."""
    found = F.lit(False)
    for w in words:
        found |= F.contains(c, F.lit(w))
    return found


def placeholder(c: Column) -> Column:
    """Whether the text has a placeholder word."""
    return has_any(F.lower(c), PLACEHOLDERS)


def file_name(rel: Column | str) -> Column:
    """The last component of a path."""
    return F.element_at(F.split(col(rel), "/"), -1)


def extension(name: Column | str) -> Column:
    """The extension in lower case; '' without one, as in names whose only dot comes first."""
    return F.regexp_extract(F.lower(col(name)), r"^.+\.([^.]*)$", 1)


def depth(rel: Column | str) -> Column:
    """The number of folders above a file."""
    return F.size(F.split(col(rel), "/")) - 1


def entropy(c: Column | str) -> Column:
    """Shannon entropy of an ASCII text, in bits a character; 0 for the empty text."""
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    n = F.size(chars).cast("double")

    def bits(total: Column, x: Column) -> Column:
        p = (F.size(F.filter(chars, lambda y: y == x)) / n).cast("double")
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), bits)


_EDGE_1 = r"^[\"'(),/:;<>\[\\\]`{|}]+|[\"'(),/:;<>\[\\\]`{|}]+$"
_EDGE_2 = r"^[\"'(),.:;\[\]`]+|[\"'(),.:;\[\]`]+$"


def trim_token(c: Column | str) -> Column:
    """A token without the punctuation around it: first what is never inside of a secret, then what only quotes or ends it."""
    return F.regexp_replace(F.regexp_replace(col(c), _EDGE_1, ""), _EDGE_2, "")


def version_like(c: Column | str) -> Column:
    """Whether a token is a version, date or time."""
    return F.regexp_replace(col(c), "[vVtTzZhHms]", "").rlike(r"^[0-9.:+-]+$")


def secret_like(c: Column | str) -> Column:
    """Whether a value may be a secret: eight bytes at least, letters and digits, no placeholder or URL, and some other character or an entropy of 3 bits."""
    v = col(c)
    return (F.octet_length(v) >= 8) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~placeholder(v) & ~F.contains(v, F.lit("://")) & (v.rlike("[^0-9A-Za-z]") | (entropy(v) >= 3.0))


def entry_rank(rel: Column | str) -> Column:
    """How early a file is read: lower comes first."""
    low = F.lower(col(rel))
    name = file_name(low)

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    return (
        depth(low) * 2
        + points(name.startswith("readme"), -100)
        + points(name.isin(*sorted(ENTRY_NAMES)), -40)
        + points(low.startswith("src/"), -10)
        + points(low.rlike("^tests?/|/tests/"), 20)
        + points(low.rlike("^docs?/"), 15)
    ).cast("int")


def anchor(rel: Column | str) -> Column:
    """The anchor of a heading."""
    return F.translate(F.regexp_replace(F.lower(col(rel)), "[^a-z0-9 -]", ""), " ", "-")


def fence(c: Column | str) -> Column:
    """Backticks that no run in the text closes: one more than the longest, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(col(c), F.lit("(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def xml_escape(c: Column | str) -> Column:
    """The text with the four characters that XML reserves."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def omit_base64(c: Column | str) -> Column:
    """The text without long base64 runs."""
    return F.regexp_replace(col(c), "[+/0-9A-Za-z]{200,}={0,2}", "[base64 omitted]")


def lines(c: Column | str) -> Column:
    """The lines of a text, without their ends; a final newline makes no further line."""
    parts = F.split(col(c), "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def drop_blank_lines(c: Column | str) -> Column:
    """The text without its blank lines, each line ended by a newline."""
    kept = F.filter(lines(c), lambda x: x.rlike(r"[^ \t\r\f]"))
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.array_join(kept, "\n"), F.lit("\n")))


def nonblank_lines(c: Column | str) -> Column:
    """The lines that aren't blank as they stand, carriage returns too, each ended by a newline: a newline alone if there are none, and no text for a null."""
    kept = F.filter(F.split(col(c), "\n"), lambda x: x.rlike(r"[^ \t\r\f]"))
    return F.coalesce(F.concat(F.array_join(kept, "\n"), F.lit("\n")), F.lit(""))


def match_newlines(new: Column | str, old: Column | str) -> Column:
    """``new`` with the line ends of ``old``: CRLF if that has any, else LF."""
    plain = F.replace(col(new), F.lit("\r\n"), F.lit("\n"))
    return F.when(F.contains(col(old), F.lit("\r\n")), F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)


#: Of each byte of UTF-8: 1 in words, 2 at the start of another sign that isn't white space, else 0.
_KIND = np.array([1 if chr(b).isalnum() or b == 95 else 0 if b in b" \t\n\r" else 2 for b in range(128)] + [0] * 64 + [2] * 64, np.uint8)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, ends): the bytes of all texts one after the other, and where each begins and ends in them."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last bytes of the runs of such bytes; a run ends with its text too, as the bytes of the next one follow at once."""
    padded = np.concatenate([[False], inside, [False]])
    opens, closes = inside & ~padded[:-2], inside & ~padded[2:]
    edges = ends[(ends > 0) & (ends < len(inside))]
    opens[edges], closes[edges - 1] = inside[edges], inside[edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes)


def count_tokens(texts: pa.Array) -> pa.Array:
    """The tokens of each text, found in all bytes of the array at once: no text is made for any of them."""
    data, ends = _bytes(texts)
    kind = _KIND[data]
    first, last = _runs(kind == 1, ends)
    upto = np.concatenate([[0], np.cumsum((last - first + 4) >> 2)])
    n = np.diff(upto[np.searchsorted(first, ends)]) + np.diff(np.searchsorted(np.flatnonzero(kind == 2), ends))
    return pa.array(n.astype(np.int64), mask=np.asarray(texts.is_null()))


def split_words(texts: pa.Array, heads: bool = False, least: int = 3) -> pa.Array:
    """The runs of at least ``least`` ASCII letters in each text, with ``heads`` only those that begin a line; none in a null."""
    data, ends = _bytes(texts)
    first, last = _runs((data | 32) - 97 < 26, ends)
    long = last - first + 1 >= least
    if heads:
        begins = np.zeros(len(data) + 1, bool)
        begins[ends[:-1]] = True
        begins[1:] |= data == 10
        long &= begins[first]
    first, last = first[long], last[long]
    kept = np.zeros(len(data) + 1, np.int8)
    kept[first] += 1
    kept[last + 1] -= 1
    letters = data[np.cumsum(kept[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
    values = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends).astype(np.int32)), values)


def words(c: Column | str, heads: bool = False) -> Column:
    """``split_words`` over a column."""

    @arrow("array<string>", once=True)
    def found(texts: pa.Array) -> pa.Array:
        return split_words(texts, heads)

    return found(col(c))


@arrow("bigint")
def _tokens(texts: pa.Array) -> pa.Array:
    return count_tokens(texts)


def token_estimate(c: Column | str) -> Column:
    """An estimate of a text's tokens that needs no vocabulary: words by four letters, and one for each other sign."""
    return _tokens(col(c))


def matches(c: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a pattern of RE2 occurs in the text: one pass over its bytes, however many alternatives the pattern has; null for a null."""

    @arrow("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern, ignore_case=ignore_case)

    return found(col(c))


def wider_estimate(tokens: Column | str) -> Column:
    """Tokens of a vocabulary that splits 1.18 times as often."""
    return F.round(col(tokens) * 1.18).cast("bigint")


def context_fit(tokens: Column | str) -> Column:
    """The smallest common context window that holds so many tokens."""
    t = wider_estimate(tokens)
    return F.when(t <= 128_000, "128k").when(t <= 200_000, "200k").when(t <= 1_000_000, "1M").otherwise("over 1M")


def short_count(n: Column | str) -> Column:
    """A count with k or M."""
    v = col(n)
    return F.when(v >= 1_000_000, F.format_string("%.1fM", v / 1e6)).when(v >= 1_000, F.format_string("%.1fk", v / 1e3)).otherwise(v.cast("string"))


def part_name(stem: Column | str, ext: Column | str, i: Column | str, n: Column | str) -> Column:
    """The file name of part ``i`` of ``n``; a single part keeps the name."""
    whole = F.concat(col(stem), F.lit("."), col(ext))
    return F.when(col(n) <= 1, whole).otherwise(F.concat(col(stem), F.lit(".part"), col(i).cast("string"), F.lit("-of-"), col(n).cast("string"), F.lit("."), col(ext)))


def safe_file_name(c: Column | str) -> Column:
    """A name that any file system takes: letters, digits, dash, underscore, dot and space, 64 characters at most; device names get a '_' before."""
    kept = F.substring(F.regexp_replace(col(c), r"[^0-9A-Za-z._ -]", ""), 1, 64)
    plain = F.regexp_replace(kept, r"^[. ]+|[. ]+$", "")
    device = F.upper(plain).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$")
    return F.when(device, F.concat(F.lit("_"), plain)).otherwise(plain)


def safe_relative(c: Column | str) -> Column:
    """A path made relative and plain, null if it leaves its root, is absolute or names a drive."""
    v = F.replace(col(c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(v, "/"), lambda x: (x != "") & (x != "."))
    bad = v.startswith("/") | F.contains(v, F.lit(":")) | F.exists(parts, lambda x: x == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def clone_url(c: Column | str) -> Column:
    """The address to clone for a repository's web address, ssh address or owner/name; null for anything else."""
    s = F.trim(col(c))
    web = F.regexp_extract(s, r"^https?://([^/\s]*\.[^/\s]*/[^\s]+?)/*$", 1)
    path = F.regexp_replace(F.regexp_replace(web, "/(tree|blob)/.*$", ""), "/+$", "")
    ok = (web != "") & web.rlike("^[^/]+/[^/]*/")
    whole = F.concat(F.lit("https://"), path)
    short = s.rlike(r"^[0-9A-Za-z_-][0-9A-Za-z._-]*/[0-9A-Za-z._-]+$")
    return (
        F.when(s.rlike(r"\s"), None)
        .when(ok, F.when(whole.endswith(".git"), whole).otherwise(F.concat(whole, F.lit(".git"))))
        .when(s.rlike("^https?://"), None)
        .when(s.rlike("^git@[^:]*:.+"), s)
        .when(short, F.concat(F.lit("https://github.com/"), s, F.lit(".git")))
    )


def scrub(c: Column | str, secret: str) -> Column:
    """The text without an access token."""
    return F.replace(col(c), F.lit(secret), F.lit("***")) if secret else col(c)


_CATEGORIES = (
    ("Credentials", ("credential", "env file", "key/certificate", "SSH")),
    ("Lock files", ("lock/system",)),
    ("Own output", ("own output",)),
    ("Too large", ("too large", "large unknown")),
    ("Binary", ("binary", "minified")),
    ("Excluded", ("excluded",)),
    ("Unknown type", ("extension",)),
)


def skip_category(reason: Column | str) -> Column:
    """The group under which a skip is reported."""
    out = F.lit("Other")
    for name, marks in reversed(_CATEGORIES):
        out = F.when(has_any(col(reason), marks), name).otherwise(out)
    return out
