"""Character conversion, name parsing and transcript normalisation as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 27 classes, in the order that breaks ties.
ALPHABET = "ABCDEFGHIKLMNOPQRSTUWXYZ&:)"

# Greek letters and their proxies. Each source character stands above its proxy.
_SHARED = (
    ("ΑἈΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΦΩ", "AABGDEZHQIKLMNXOPRSTFW"),
    ("αᾶᾷἆἇᾆᾇὰάἀἁἄἅἂἃ", "a" * 15),
    ("εἐἑὲέἔἕἒἓ", "e" * 9),
    ("ηἦἧᾖᾗῆῇἢἣἠἡἤἥὴή", "h" * 15),
    ("ιἶἷῖὶίἰἱἴἵἲἳ", "i" * 12),
    ("οὸόὀὁὄὅὂὃ", "o" * 9),
    ("ωᾦᾧὦὧῶῷὼώὠὡὤὥὢὣ", "w" * 15),
    ("βγδζθκλμνξπρςστφ", "bgdzqklmnxprvstf"),
    ("’Ὑ̣ ·․⁷", "'`_ ..7"),
)
_UPSILONS = "ὖὗῦὐὑὔὕὒὓὺύ"
_NEW = (("ΥΧΨυχψ", "YCUycu"), (_UPSILONS, "y" * 11), ("\u0003", " "))
_OLD = (("ΥΧΨυχψ", "UYCuyc"), (_UPSILONS, "u" * 11), ("͂", "n"))


def _map(*parts: tuple[str, str]) -> tuple[str, str]:
    return "".join(a for a, _ in parts), "".join(b for _, b in parts)


NEW_MAP = _map(*_SHARED, *_NEW)
OLD_MAP = _map(*_SHARED, *_OLD)
LATIN_MAP = ("YCUycu", "CUYcuy")


def convert(text: Column, use_old: bool = False) -> Column:
    """Greek letters as Latin proxies in upper case; the old map differs in upsilon, chi, psi, U+0342 and U+0003."""
    return F.upper(F.translate(text, *(OLD_MAP if use_old else NEW_MAP)))


def latin_swap(text: Column) -> Column:
    """Y to C, C to U and U to Y in both cases, for predictions converted with the other map."""
    return F.translate(text, *LATIN_MAP)


def normalise(text: Column, use_old: bool = False) -> Column:
    """A transcript as it is scored: converted, without spaces and tabs, rows as an array."""
    return F.split(F.translate(convert(text, use_old), " \t", ""), "\n", -1)


def keep_alphabet(text: Column) -> Column:
    """Upper-case characters that are one of the classes; others go."""
    return F.regexp_replace(F.upper(text), f"[^{ALPHABET}]", "")


def safe_name(text: Column) -> Column:
    """File-name part: runs of other characters become one underscore, outer ones go; ``none`` if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit("")), F.lit("none"))


def data_set_slug(text: Column) -> Column:
    """Name of an input: without a known prefix and outer slashes, at most 140 characters, ``input`` if empty."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(text), "^hf://datasets/", ""), "^https://huggingface\\.co/datasets/", "")
    safe = F.regexp_replace(F.btrim(bare, F.lit("/")), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.btrim(safe, F.lit("._-")), 1, 140), F.lit("")), F.lit("input"))


def safe_base(text: Column) -> Column:
    """Object id safe in a path: at most 180 characters, ``squeeze`` if empty."""
    safe = F.regexp_replace(F.translate(F.btrim(text), "/", "_"), "[^A-Za-z0-9._+:-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.btrim(safe, F.lit("._-")), 1, 180), F.lit("")), F.lit("squeeze"))


def stem(path: Column) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)/?$", 1), "(?<=.)\\.[^.]*$", "")


def rotation(name: Column) -> Column:
    """``Rotation1`` or ``Rotation2`` from a file name, else null."""
    return F.nullif(F.regexp_extract(stem(name), "_(Rotation[12])_300dpi", 1), F.lit(""))


def base_id(name: Column) -> Column:
    """Object id of a file name: without its rotation and merge marks."""
    return F.replace(F.regexp_replace(stem(name), "_Rotation[12]_300dpi$", ""), F.lit("_Merged"), F.lit(""))


def clip_squeeze(name: Column) -> Column:
    """A name up to the earlier of ``_Rotation`` and ``_Merged`` behind its first character."""
    n = F.length(name)
    at = [F.instr(name, mark) - 1 for mark in ("_Rotation", "_Merged")]
    return F.substring(name, F.lit(1), F.least(*[F.when(i > 0, i).otherwise(n) for i in at]))
