"""Text expressions: Column in, Column out, all evaluated in the JVM.

Regular expressions name their character classes outright, so that they mean the same in Java and in other engines. Lines
are separated by any line break; one at the end starts no further line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The script class, marks dropped from signatures, and white space beyond ASCII.
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
SIGNATURE_MARKS = r"\x{064B}-\x{0670}\x{065F}\x{0640}"
SPACE = r"\s\x0B\x1C-\x1F\x{0085}\p{Z}"
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}]"


def nonempty(value: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(value, F.lit(""))


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*map(nonempty, values), F.lit(""))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, rf"(?:{BREAK})\z", ""), BREAK, -1)


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def clean_title_space(title: Column) -> Column:
    """White space runs as one space, none at the ends, null when nothing is left."""
    return nonempty(trim_space(F.regexp_replace(title, f"[{SPACE}]+", " ")))


def clean_text_space(text: Column) -> Column:
    """At most one blank line in a row, no white space at line ends or around the text."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), rf"(?!\n)(?:{BREAK})", "\n")
    return trim_space(F.regexp_replace(text, r"(?dm)[\p{Zs}\t\x1F]+$", ""))


def split_last(title: Column, separator: str = "»", if_starts_with: str | None = None) -> Column:
    """What stands behind the last separator, unless that is empty or the title lacks the separator or the start."""
    last = nonempty(trim_space(F.substring_index(title, separator, -1)))
    guard = F.contains(title, F.lit(separator))
    if if_starts_with:
        guard &= F.startswith(title, F.lit(if_starts_with))
    return F.when(guard, F.coalesce(last, title)).otherwise(title)


def truncate_before_first_of(text: Column, markers: list[str]) -> Column:
    """The lines before the first that contains a marker."""
    if not markers:
        return text
    parts = lines(text)
    hit = lambda line: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(line, m))
    places = F.filter(F.transform(parts, lambda line, i: F.when(hit(line), i)), lambda i: i.isNotNull())
    return join_lines(F.slice(parts, F.lit(1), F.coalesce(F.array_min(places), F.size(parts))))


def strip_lines_matching(text: Column, pattern: str) -> Column:
    return join_lines(F.filter(lines(text), lambda line: ~F.rlike(line, F.lit(pattern)))) if pattern else text


def date_dmy(text: Column, pattern: str) -> Column:
    """The first match's groups, day, month and year, as an ISO date; null when there is none or it isn't plausible."""
    day, month, year = (F.try_cast(F.regexp_extract(text, pattern, k), "int") if hasattr(F, "try_cast") else F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2, 3))
    ok = day.between(1, 31) & month.between(1, 12) & year.between(1900, 2100)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.when(ok, F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)))


def remove_first(text: Column, pattern: str) -> Column:
    """The text without the first match alone."""
    match, at = F.regexp_substr(text, F.lit(pattern)), F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(match), F.length(text)))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""))


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: trim_space(x) != ""))


def script_ratio(text: Column, script: str = ARABIC) -> Column:
    """Characters of a script as a share of those that aren't white space; 0 where there are none."""
    total = F.length(F.regexp_replace(text, f"[{SPACE}]", ""))
    return F.when(total > 0, F.regexp_count(text, F.lit(f"[{script}]")) / total).otherwise(F.lit(0.0))


def language(text: Column, script: str = ARABIC, tag: str = "ar", least: float = 0.5) -> Column:
    return F.when(script_ratio(text, script) >= least, tag).otherwise("other")


def content_id(title: Column, text: Column) -> Column:
    """Sixteen hex digits of a record's content."""
    return F.left(F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("||"), text), 256), F.lit(16))


def signature(text: Column) -> Column:
    """A form that is alike for texts that differ in marks, case, punctuation and white space."""
    text = F.lower(F.regexp_replace(text, f"[{SIGNATURE_MARKS}]", ""))
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]+", " "))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k code points; a shorter text is one, an empty one has none."""
    # the outer transform binds the characters, which are split once: taking a substring would walk the text each time
    runs = lambda cs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(cs, i, F.lit(k)), ""))
    chars = F.transform(F.filter(F.array(text), lambda t: t != ""), lambda t: F.split(t, "", -1))
    return F.array_distinct(F.flatten(F.transform(chars, runs)))


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """64-bit hashes of the distinct runs of k code points, without the runs themselves."""
    last = lambda cs: F.greatest(F.size(cs) - k, F.lit(0))
    hashes = lambda cs: F.transform(F.sequence(F.lit(0), last(cs)), lambda i: F.xxhash64(*(F.get(cs, i + j) for j in range(k))))
    chars = F.transform(F.filter(F.array(text), lambda t: t != ""), lambda t: F.split(t, "", -1))
    return F.array_distinct(F.flatten(F.transform(chars, hashes)))


def clean_labels(labels: Column, drop_starts: str = "المزيد", drop_equal: str = "متابعة", sep: str = "|") -> Column:
    """Trimmed non-empty labels of a joined string, without link texts and buttons; null when none is left."""
    parts = F.transform(F.split(labels, f"[{sep}]"), lambda x: F.trim(x))
    return nonempty(F.array_join(F.filter(parts, lambda x: (x != "") & ~F.startswith(x, F.lit(drop_starts)) & (x != drop_equal)), sep))


def passage(title: Column, text: Column, prefix: str = "passage: ") -> Column:
    """Title and text, for embedding; a title that the text starts with isn't repeated."""
    both = F.when(nonempty(title).isNull() | F.startswith(text, title), text).otherwise(F.concat(title, F.lit("\n\n"), text))
    return F.concat(F.lit(prefix), both)


def seconds(hms: Column) -> Column:
    """H:M:S, M:S or S as seconds; 0.0 for anything else."""
    parts = F.split(F.trim(hms), ":")
    values = F.transform(parts, lambda p: p.try_cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when(F.size(parts) <= 3, F.coalesce(total, F.lit(0.0))).otherwise(F.lit(0.0))


def join_segments(segments: Column) -> Column:
    """Trimmed, non-empty segment texts on lines."""
    return join_lines(F.filter(F.transform(segments, lambda s: trim_space(s)), lambda s: s != ""))


def anchor(title: Column, ordinal: Column, fallback: str = "poem") -> Column:
    """A heading's link name."""
    name = F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}_]+", "-")
    return F.coalesce(nonempty(F.regexp_replace(name, "^-+|-+$", "")), F.concat(F.lit(f"{fallback}-"), ordinal.cast("string")))


def size_bracket(total: Column) -> Column:
    steps = [(1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M")]
    out = F.when(total < steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        out = out.when(total < limit, name)
    return out.otherwise("n>1M")


def subject_label(native: Column, english: Column, slug: Column) -> Column:
    native, english = nonempty(native), nonempty(english)
    return F.coalesce(F.concat(native, F.lit(" ("), english, F.lit(")")), native, english, slug)


def prompt_hash(prompt: Column) -> Column:
    return F.left(F.sha2(prompt, 256), F.lit(12))


def preferred(tracks: Column, *names: str) -> Column:
    """The first present track of a map."""
    return F.coalesce(*(F.try_element_at(tracks, F.lit(n)) for n in names))
