"""Classification of files: ordered rules of which the first that holds decides, each skip with its reason.

The rules that need only names and sizes are one expression over columns; content is looked at in a later step, and only for
the files whose names leave it open, so that it is read for no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.functions.text import col, extension, file_name, has_any

SNIFF_BYTES, LONG_LINE, UNKNOWN_BYTES = 8192, 1000, 524_288


@dataclass(frozen=True)
class ScanOptions:
    """What a scan takes in."""

    include_venv: bool = False
    content_sniff: bool = True
    include_hidden: bool = False
    respect_gitignore: bool = True
    max_file_size: int = 2 * 1024 * 1024
    text_extensions: tuple[str, ...] = ()
    skip_extensions: tuple[str, ...] = ()
    binary_extensions: tuple[str, ...] = ()
    include_globs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = field(default=())


def is_venv(folder: Column | str) -> Column:
    """Whether a folder holds a Python environment, by its name."""
    low = F.lower(col(folder))
    return low.isin(*sorted(N.VENV_NAMES)) | low.rlike("(^|[^a-z])(venv|virtualenv|site-packages)([^a-z]|$)")


def is_pruned(folder: Column | str) -> Column:
    """Whether a folder is never entered."""
    return F.lower(col(folder)).isin(*sorted(N.PRUNED_FOLDERS), "system volume information")


def is_own_output(name: Column | str) -> Column:
    """Whether a file is an earlier result."""
    tail = F.regexp_extract(F.lower(col(name)), r"^.*_merged\.(.*)$", 1)
    return tail.rlike(r"^(md|xml|json|txt)$|^part.*\.(md|xml|json|txt)$")


def is_minified(name: Column | str) -> Column:
    """Whether a file is minified or bundled, by its name."""
    return F.lower(col(name)).rlike(r"\.(min\.(js|css|mjs)|chunk\.js|bundle\.js)$")


def sensitive_reason(name: Column | str) -> Column:
    """Why a file may hold credentials, by its name; null if it doesn't look so."""
    low = F.lower(col(name))
    ext = extension(low)
    stem = F.regexp_replace(low, r"\.[^.]*$", "")
    template = low.isin(".env.example", ".env.sample", ".env.template")
    return (
        F.when((low == ".env") | (low.startswith(".env.") & ~template), "env file (may hold credentials)")
        .when(ext.isin(*sorted(N.KEY_EXTENSIONS)), "key/certificate material")
        .when(low.rlike("^id_(rsa|ed25519|ecdsa|dsa)"), "SSH private key")
        .when(low.isin(*sorted(N.CREDENTIAL_STORES)), "credential store")
        .when(F.regexp_extract(low, r"\.([^.]*)$", 1).isin(*sorted(N.DATA_EXTENSIONS)) & has_any(stem, N.DATA_MARKERS), "credential/secret data file")
    )


def name_verdict(name: Column | str, size: Column | str, options: ScanOptions = ScanOptions()) -> Column:
    """(verdict, reason) by name and size.

    ``verdict``: text, skip, binary, or sniff where only the content can tell.
    """
    raw, n = col(name), col(size)
    low, ext = F.lower(raw), extension(raw)
    text = ext.isin(*sorted(N.TEXT_EXTENSIONS | set(options.text_extensions)))
    unknown = F.lit("sniff") if options.content_sniff else F.lit("skip")
    large = F.concat(F.lit("too large ("), F.floor(n / 1024).cast("string"), F.lit(" KB)"))
    rules = [
        (~F.is_valid_utf8(raw), "skip", F.lit("unrepresentable file name")),
        (low.isin(*sorted(N.LOCK_FILES)), "skip", F.lit("lock/system file (context bloat)")),
        (is_own_output(raw), "skip", F.lit("own output (an earlier result)")),
        (is_minified(raw), "binary", F.lit("minified or bundled")),
        (sensitive_reason(raw).isNotNull(), "skip", sensitive_reason(raw)),
        (n > options.max_file_size, "skip", large),
        (ext.isin(*options.skip_extensions) if options.skip_extensions else F.lit(False), "skip", F.lit("extension excluded by configuration")),
        (ext.isin(*sorted(N.BINARY_EXTENSIONS | set(options.binary_extensions))), "binary", F.lit("binary extension")),
        ((n > UNKNOWN_BYTES) & ~text & ~((ext == "") & low.isin(*sorted(N.TEXT_NAMES))), "skip", F.lit("large unknown file")),
        (text, "text", F.lit(None)),
        ((ext == "") & low.isin(*sorted(N.TEXT_NAMES)), "text", F.lit(None)),
        (ext != "", unknown, F.lit(None) if options.content_sniff else F.lit("unknown extension (content detection off)")),
    ]
    last = (unknown, F.lit(None) if options.content_sniff else F.lit("no extension (content detection off)"))

    def pair(v: Column | str, r: Column) -> Column:
        return F.struct((v if isinstance(v, Column) else F.lit(v)).alias("verdict"), r.cast("string").alias("reason"))

    out = pair(*last)
    for test, v, r in reversed(rules):
        out = F.when(test, pair(v, r)).otherwise(out)
    return out


def looks_binary(text: Column | str) -> Column:
    """Whether a decoded text looks binary or encoded: control characters, mostly non-ASCII bytes, or very long lines.

    Looks at the first SNIFF_BYTES bytes; the bytes of a whole file are judged by ``corpusmill.sources.bytes``.
    """
    head = F.substring(F.encode(col(text), "UTF-8"), 1, SNIFF_BYTES)
    shown = F.decode(head, "ISO-8859-1")
    n = F.octet_length(head)
    control = F.regexp_count(shown, F.lit(r"[\x01-\x08\x0E-\x1F]"))
    high = F.regexp_count(shown, F.lit(r"[\x80-\xFF]"))
    longest = F.array_max(F.transform(F.split(shown, "\n"), F.length))
    return (n > 0) & ((control * 100 > n * 10) | (high * 100 > n * 40) | (longest > LONG_LINE))


def classify(files: DataFrame, options: ScanOptions = ScanOptions(), name: str = "name", size: str = "size", text: str = "text") -> DataFrame:
    """``files`` with ``verdict`` (text, skip, binary) and ``reason``."""
    named = files.withColumn("__v", name_verdict(name, size, options))
    binary = looks_binary(text)
    verdict = F.when(F.col("__v.verdict") == "sniff", F.when(binary, "binary").otherwise("text")).otherwise(F.col("__v.verdict"))
    reason = F.when(F.col("__v.verdict") == "sniff", F.when(binary, "binary content")).otherwise(F.col("__v.reason"))
    return named.withColumn("verdict", verdict).withColumn("reason", reason).drop("__v")


def with_names(files: DataFrame, rel: str = "rel") -> DataFrame:
    """``files`` with ``name`` from the path."""
    return files.withColumn("name", file_name(rel))
