"""Scalar text functions, Column to Column. All run inside the JVM.

Missing values: '' and null mean the same to the callers of these functions; nulls pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, in a character class that Java and RE2 both read.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same without the no-break space.
WS_BREAKING = WS.replace(r"\x{A0}", "")

MARK = "\x01"


def char_class(chars: str) -> str:
    """The characters as the inside of a regular-expression class, each by its number."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


def quoted_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


# --- titles and lines -------------------------------------------------------------------------


def sanitize_title(title: Column) -> Column:
    """Bracketed leftovers go, from the first opening to the last closing bracket of a line; so do carriage returns."""
    return F.replace(F.regexp_replace(title, r"[\[{].*[\]}]", ""), F.lit("\r"), F.lit(""))


def all_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def sanitize_id(name: Column) -> Column:
    return F.translate(name, " \r\n", "")


def first_char(text: Column) -> Column:
    return F.substring(text, 1, 1)


def first_word(text: Column, most: int = 0) -> Column:
    """First run of non-spaces, at most ``most`` code points of it (all if 0 or less)."""
    word = F.regexp_extract(text, f"^[{WS}]*([^{WS}]*)", 1)
    return F.substring(word, 1, most) if most > 0 else word


def abbreviation(text: Column) -> Column:
    """First letter of every word that has one."""
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"(?:^|[{WS}])[^\p{{L}}{WS}]*(\p{{L}})"), F.lit(1)), "")


def is_one_of(value: Column, names: Column) -> Column:
    return F.exists(names, lambda n: F.lower(n) == F.lower(value))


def append_if_missing(values: Column, value: Column) -> Column:
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def pad_number(number: Column, width: int) -> Column:
    """Zero-padded; longer numbers stay whole; blank for 0 and below."""
    text = number.cast("string")
    return F.when(number > 0, F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))).otherwise("")


def title_case(name: Column) -> Column:
    return F.initcap(name)


def bracket_note_title(title: Column) -> Column:
    """An integer title becomes a label."""
    return F.when(title.rlike(r"^[+-]?[0-9]+$"), F.concat(title, F.lit(") "))).otherwise(title)


# --- links ------------------------------------------------------------------------------------


def slashes(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("/"))


def href_fragment(href: Column) -> Column:
    """What follows the first '#'; null without one."""
    return F.when(F.contains(href, F.lit("#")), F.regexp_extract(slashes(href), "#(.*)$", 1))


EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
URL = r"^(?:(?:https?|ftp)://)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?::[0-9]+)?(?:/[^ ]*)?$"


def anchor_href(href: Column, text: Column) -> Column:
    """The href with forward slashes; for an anchor without one, its text if that is a URL or e-mail; else null."""
    candidate = F.btrim(slashes(F.trim(text)), F.lit(".,"))
    return F.when(F.coalesce(href, F.lit("")) != "", slashes(href)).when(candidate.rlike(EMAIL) | candidate.rlike(URL), candidate)


#: Characters that stay as they are in parameter values, and what a form encoder makes of them. Fixed values.
KEPT = {"$": "%24", "&": "%26", "+": "%2B", "=": "%3D", ":": "%3A", "@": "%40", "~": "%7E"}


def percent_encode(text: Column) -> Column:
    """UTF-8 bytes as %XX, but for ASCII letters, digits and ``$&+=:@_.~-``."""
    # a form encoder writes a blank as + and leaves *; a % of its output always begins an escape
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for char, escape in KEPT.items():
        out = F.replace(out, F.lit(escape), F.lit(char))
    return out


def percent_encode_parts(name: Column, prefix: str = "UTF-8''", width: int = 74) -> Column:
    """Chunks of the percent-encoded name, cut at character borders; the prefix counts toward the first."""
    # the longest run that ends neither inside an escape nor before a byte that continues a character
    part = rf"(.{{1,{width}}}(?<!%)(?<!%.)(?!%[89AB]))"
    return F.regexp_extract_all(F.concat(F.lit(prefix), percent_encode(name)), F.lit(part), F.lit(1))


# --- names of files and books -----------------------------------------------------------------


def safe_name(text: Column) -> Column:
    return F.concat(F.lit("zz"), F.md5(F.encode(text, "UTF-8")))


#: What no file name may hold, by system.
FORBIDDEN = {"unix": "/:", "windows": "<>\":/\\|?*" + "".join(map(chr, range(32)))}


def clean_file_name(name: Column, system: str = "unix") -> Column:
    cleaned = F.ltrim(F.regexp_replace(name, f"[{char_class(FORBIDDEN[system])}]", ""), F.lit("."))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("_bad_file_name_"))


def output_path(source_dir: Column, name: Column, extension: Column, flat: bool = False) -> Column:
    """Directory of the source (unless flat), the parts of the formatted name cleaned, and the extension."""
    cleaned = F.array_join(F.transform(F.split(name, "/"), lambda part: clean_file_name(part)), "/")
    path = F.concat(cleaned, F.lit("."), extension)
    return path if flat else F.concat_ws("/", F.nullif(source_dir, F.lit("")), path)


#: Letters beyond ASCII and what stands for them; digraphs are replaced first.
DIGRAPHS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", ""))
LETTERS = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿабвгдеёзийклмнопрстуфыэ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyabvgdeeziiklmnoprstufye"


def slugify(text: Column) -> Column:
    """Latin and Cyrillic letters in ASCII, lower case; everything else becomes single hyphens."""
    out = F.lower(text)
    for letter, plain in DIGRAPHS:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.btrim(F.regexp_replace(F.translate(out, LETTERS, PLAIN), "[^a-z0-9]+", "-"), F.lit("-"))


# --- normalisation of paragraph text; callers apply speech, dashes, dialogue in this order -------


def normalize_speech(text: Column, starts: str, to: str) -> Column:
    """A paragraph that starts with a character of ``starts``, blanks or not, and goes on: that lead becomes ``to``."""
    return F.regexp_replace(text, f"^[{char_class(starts)}][{WS}]*(?=[^{WS}])", quoted_replacement(to))


def normalize_dashes(text: Column, dashes: str, to: str) -> Column:
    """A dash between white space becomes ``to``."""
    return F.regexp_replace(text, f"(?<=[{WS}])[{char_class(dashes)}](?=[{WS}])", quoted_replacement(to))


def normalize_dialogue(text: Column, dashes: str, to: str) -> Column:
    """White space before a dash that does not begin the text becomes ``to``; other runs collapse to their last character."""
    single = F.regexp_replace(text, f"[{WS}](?=[{WS}])", "")
    dash = char_class(dashes)
    moved = F.regexp_replace(single, rf"[{WS}]([{dash}])|(?<=[\s\S])([{dash}])", quoted_replacement(to) + "$1$2")
    # most text holds neither a dash nor a run of white space: one look leaves it as it is
    return F.when(~text.rlike(f"[{WS}][{WS}]|[{dash}]|^[{WS}]$"), text).when(text.rlike(rf"^[{WS}]\z"), "").otherwise(moved)


# --- sentences and words ----------------------------------------------------------------------

#: Our own abbreviations after which no sentence ends, by language. Fixed values.
ABBREVIATIONS: dict[str, Sequence[str]] = {
    "en": ("Mr", "Mrs", "Dr", "St", "vs", "etc"),
    "de": ("Hr", "Fr", "Dr", "Nr", "bzw", "usw"),
    "fr": ("M", "Mme", "Dr", "etc", "cf"),
    "es": ("Sr", "Sra", "Dr", "etc", "pág"),
}
_SENTENCE_END = rf"([.!?…]+[{WS}]+)"


def split_sentences(text: Column, lang: Column, abbreviations: dict[str, Sequence[str]] = ABBREVIATIONS) -> Column:
    """Sentences whose concatenation is the text. Blanks belong to the sentence before them.

    Borders are marked first, then marks after an abbreviation of the language go; a language without a table gives one sentence.
    """
    marked = F.regexp_replace(text, _SENTENCE_END, "$1" + MARK)
    out = F.when(F.lit(False), F.array(text))
    for name, words in abbreviations.items():
        joined = F.regexp_replace(marked, rf"((?:^|[^\p{{L}}])(?:{'|'.join(words)})\.[{WS}]+){MARK}", "$1")
        out = out.when(lang == name, F.filter(F.split(joined, MARK), lambda s: s != ""))
    return out.otherwise(F.filter(F.array(text), lambda s: s != ""))


def split_words(sentence: Column, ignore_nbsp: bool = False) -> Column:
    """Every separator splits, so that runs leave empty words. The no-break space separates only if asked."""
    return F.split(sentence, f"[{WS if ignore_nbsp else WS_BREAKING}]", -1)


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


def text_length(words: Column) -> Column:
    """Code points of the words and of one blank between neighbours."""
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w)) + F.greatest(F.size(words) - 1, F.lit(0))


def drop_cap(text: Column, ignore: str) -> Column:
    """What a first paragraph sets as drop cap: up to and including the first character not in ``ignore``; '' for a blank."""
    word = F.regexp_extract(text, f"^[^{WS_BREAKING}]*", 0)
    return F.regexp_extract(word, f"^[{char_class(ignore)}]*[^{char_class(ignore)}{WS}]", 0) if ignore else F.regexp_extract(word, f"^[^{WS}]", 0)
