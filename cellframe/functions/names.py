"""Names, keys and labels: path splitting, cell ids, category identity, natural order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers a channel name is recognised by, and the emission
# band (nm) of the nuclear stains.
BRIGHTFIELD_HINTS = ("bf", "brightfield", "bright field", "dic", "transmitted", "trans", "white light")
TARGET_HINTS = ("dapi", "hoechst")
TARGET_BAND_NM = (400.0, 500.0)


# Fixed value: the characters that count as blank at either end of a name.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(name) -> Column:
    return F.trim(_col(name), F.lit(BLANKS))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def container_of(path) -> Column:
    """Everything before the last slash of a tile reference."""
    return F.regexp_extract(_col(path), r"^(.*)/([^/]*)$", 1)


def cell_of(path) -> Column:
    """Everything after the last slash of a tile reference."""
    return F.regexp_extract(_col(path), r"^(.*)/([^/]*)$", 2)


def tile_display_name(cell_id, with_fov: bool = True) -> Column:
    """``x_cell00017`` shown as ``x · cell 17``; any other id as it is."""
    c = _col(cell_id)
    pattern = r"^(.*)_cell([0-9]+)$"
    digits = F.regexp_replace(F.regexp_extract(c, pattern, 2), r"^0+([0-9])", "$1")
    short = F.concat(F.lit("cell "), digits)
    shown = F.concat(F.regexp_extract(c, pattern, 1), F.lit(" · "), short) if with_fov else short
    return F.when(c.rlike(pattern), shown).otherwise(c)


def cell_id_for(fov_id, label) -> Column:
    """Five digits at least; wider labels keep all of theirs."""
    return F.format_string("%s_cell%05d", _col(fov_id), _col(label).cast("long"))


def category_key(name) -> Column:
    """Identity of a category name: outer whitespace and letter case don't count."""
    return F.lower(stripped(name))


def natural_key(name) -> Column:
    """Sort key under which digit runs order as numbers and text ignores case.

    Text and digit runs alternate, starting with (possibly empty) text. A digit
    run becomes its length, then its digits, so any length compares right: four
    digits give the length, and from 9999 on ten more follow them.
    """
    s = _col(name)
    runs = F.regexp_extract_all(s, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def token(t):
        bare = F.regexp_replace(t, r"^0+([0-9])", "$1")
        n = F.length(bare).cast("string")
        size = F.when(F.length(bare) < 9999, F.lpad(n, 4, "0")).otherwise(F.concat(F.lit("9999"), F.lpad(n, 10, "0")))
        return F.when(t.rlike("^[0-9]"), F.concat(size, bare)).otherwise(F.lower(t))

    keyed = F.transform(runs, token)
    return F.when(s.rlike("^[0-9]"), F.concat(F.array(F.lit("")), keyed)).otherwise(keyed)


def in_fovs(cell_id, fov_names: list[str]) -> Column:
    """Does the tile belong to one of the named fields of view."""
    tests = [F.startswith(_col(cell_id), F.lit(f"{n}_cell")) for n in fov_names]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def strip_legacy_suffix(key) -> Column:
    return F.regexp_replace(_col(key), r"\.tif$", "")


def tag_source(category, confidence) -> Column:
    """Who set a tag: nobody, a human, or a model whose guess nobody confirmed yet."""
    empty = _col(category).isNull() | (_col(category) == "")
    return F.when(empty, "").when(_col(confidence).isNull(), "human").otherwise("ai")


def extract_by_pattern(name, pattern: str) -> Column:
    """Group 1 of the first match, the whole match for a pattern without groups, else NULL."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(_col(name).rlike(pattern), F.regexp_extract(_col(name), pattern, group))


def channel_name_matches(name, hints) -> Column:
    """Hints of up to five letters must be a whole word, longer ones may sit anywhere."""
    low = F.lower(F.coalesce(_col(name), F.lit("")))
    words = "|".join(re.escape(h) for h in hints if len(h) <= 5)
    tests = [f"(?<![a-z])(?:{words})(?![a-z])"] if words else []
    tests += [re.escape(h) for h in hints if len(h) > 5]
    return low.rlike("|".join(tests))


def parse_vocab_header(line) -> Column:
    """Category list of a ``#categories`` header line; NULL for any other line.

    After the word may follow a colon; the names are split at tabs if there are
    any, else at commas if there are any, else at blanks.
    """
    raw = _col(line)
    is_header = raw.rlike(r"^#categories($|[^\p{L}\p{N}])")
    rest = stripped(F.regexp_replace(raw, r"^#categories:*", ""))
    parts = (
        F.when(F.contains(rest, F.lit("\t")), F.split(rest, "\t"))
        .when(F.contains(rest, F.lit(",")), F.split(rest, ","))
        .otherwise(F.split(rest, " "))
    )
    names = F.transform(parts, stripped)
    return F.when(is_header, F.filter(names, lambda n: n != ""))
