"""Text, digest and validation expressions.  All are JVM-side column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space at either end of a text.
ENDS = r"\A[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\z"
KNOWN_LAYOUTS = ("root-plugin", "monorepo", "suite")
STALE_SECONDS = 30 * 86400


def normalize_repository(url: Column) -> Column:
    """One spelling per repository: trimmed, ASCII lower case, without scheme, ``www.``,
    trailing slashes and then trailing ``.git``; ``git@host:path`` becomes ``host/path``."""
    bare = F.translate(F.regexp_replace(url, ENDS, ""), UPPER, LOWER)
    scp = F.regexp_replace(F.regexp_replace(bare, r"\Agit@", ""), r"\A([^:]*):", "$1/")
    path = F.when(bare.rlike(r"\A(?:https://|http://|ssh://git@)"), F.regexp_replace(bare, r"\A(?:https://|http://|ssh://git@)", ""))
    path = path.when(bare.startswith("git@"), scp).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\Awww\.", ""), r"/+\z", ""), r"(?:\.git)+\z", "")


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def big_endian(number: Column, width: int) -> Column:
    """*number* as *width* bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * width, "0"))


def safe_text(text: Column) -> Column:
    """Control characters other than line feed and tab as ``\\u{hex}``."""
    shown = lambda c: F.when(
        c.rlike(r"\A\p{Cc}\z") & ~c.isin("\n", "\t"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c).cast("long"))), F.lit("}"))
    ).otherwise(c)
    return F.when(text.rlike(r"[\p{Cc}&&[^\n\t]]"), F.array_join(F.transform(F.split(text, ""), shown), "")).otherwise(text)


def shown_line(*values: Column) -> Column:
    """One line of text output: the values, control characters escaped (line feeds and tabs too), between tabs; null shows as nothing."""
    cell = lambda v: F.regexp_replace(F.regexp_replace(safe_text(F.coalesce(v.cast("string"), F.lit(""))), "\n", r"\\n"), "\t", r"\\t")
    return F.concat_ws("\t", *[cell(v) for v in values])


def format_timestamp(seconds: Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DDTHH:MM:SSZ`` in UTC, whatever the session zone."""
    days = F.floor(seconds / F.lit(86400))
    rest = seconds - days * 86400
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    day = F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")
    return F.concat(
        day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z")
    )


def age_seconds(seconds: Column, now: int) -> Column:
    """Seconds from a time to *now*, never below zero; null stays null."""
    return F.when(seconds.isNotNull(), F.greatest(F.lit(now).cast("long") - seconds, F.lit(0).cast("long")))


def is_stale(seconds: Column, now: int) -> Column:
    """Older than thirty days; an unknown time is not stale."""
    return F.coalesce(age_seconds(seconds, now) > STALE_SECONDS, F.lit(False))


def is_backup(name: Column) -> Column:
    return name.endswith(".bak") | name.contains(".bak.") | name.endswith(".backup") | name.endswith("~")


def valid_commit(text: Column) -> Column:
    """40 or 64 ASCII hex digits."""
    return F.coalesce(text.rlike(r"\A(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})\z"), F.lit(False))


def valid_ref(text: Column) -> Column:
    """1 to 256 bytes of the characters of a revision name, no leading dash."""
    return F.coalesce(text.rlike(r"\A(?!-)[A-Za-z0-9_/.^~-]+\z") & (F.octet_length(text) <= 256), F.lit(False))


def is_https(url: Column) -> Column:
    return F.coalesce(url.startswith("https://"), F.lit(False))


def known_layout(layout: Column) -> Column:
    """A null layout is fine, an unknown one is not."""
    return layout.isNull() | layout.isin(*KNOWN_LAYOUTS)


def split_range(text: Column) -> Column:
    """(start, end) of ``start..end``, at the first ``..``; without it end is null."""
    at = F.instr(text, "..")
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("start"),
        F.when(at > 0, F.substring(text, at + 2, F.length(text))).alias("end"),
    )


def truncated(text: Column, limit: int) -> Column:
    """(text, truncated): at most *limit* bytes, cut at a character's start."""
    data = F.encode(text, "UTF-8")
    # The byte after the cut must start a character (or be none); of four bytes in a row one does.
    ends = [F.when(~F.hex(F.substring(data, n + 1, 1)).rlike("^[89AB]"), F.lit(n)) for n in range(limit, max(limit - 4, -1), -1)]
    head = F.decode(F.substring(data, F.lit(1), F.coalesce(*ends)), "UTF-8")
    cut = F.octet_length(text) > limit
    return F.struct(F.when(cut, head).otherwise(text).alias("text"), cut.alias("truncated"))


def as_expected(value: Column, expected: Column) -> Column:
    """Both null, or both there and equal."""
    return value.eqNullSafe(expected)


def is_dirty(status: Column) -> Column:
    """Whether a work tree's status output says anything; unknown stays null."""
    return F.length(status) > 0
