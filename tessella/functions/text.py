"""Text functions as Spark columns: normalisation, tokens, stems, cleaning, headings and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word, and hyphens that count as "-".
WORD = "[0-9a-zа-яёı]+(?:[._/-][0-9a-zа-яёı]+)*"
HYPHENS = "‐‑−"

def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss, which is what full case folding adds for Latin text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def lexical_normalize(text: Column) -> Column:
    """Typographic hyphens as "-", case folded, ё as е. Compatibility forms are expected to be normalised on ingestion."""
    out = casefold(text)
    for sign, plain in (*((h, "-") for h in HYPHENS), ("ё", "е")):  # replace() is a byte search where translate() looks up every character
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def tokens(text: Column) -> Column:
    """Words of a normalised text, codes such as 17.25 or axis-p1375 in one piece; null gives none."""
    return F.coalesce(F.regexp_extract_all(lexical_normalize(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


#: Endings of the light stemmer in the order in which they are tried.
LIGHT_ENDINGS = (
    "иями ям ыми ейший ейшая ейшее ейшие ейших ого его ому ему ыми ими ых их ою ею ая яя ое ее ые ие ым им ом ем ах ях ов ев ей ам ям ит ет ут ют ат ят ти а ев ов е и й о у ы ь я ю ию"
).split()


def light_stem(word: Column) -> Column:
    """A Cyrillic word of at least four letters without the first of LIGHT_ENDINGS whose removal leaves four."""
    out = word
    for end in reversed(LIGHT_ENDINGS):
        out = F.when(word.endswith(end) & (F.length(word) - len(end) >= 4), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return F.when(word.rlike("^[а-яё]{4,}$"), out).otherwise(word)


def saturated_integer(text: Column) -> Column:
    """A whole number with an optional sign and single low lines between digits, held within 64 bits; null for anything else."""
    plain = F.trim(text)
    digits = F.regexp_replace(F.regexp_replace(plain, "[^0-9]", ""), "^0+", "")
    over = (F.length(digits) > 19) | (digits.try_cast("decimal(20,0)") > F.lit(9223372036854775807))
    size = F.coalesce(F.nullif(digits, F.lit("")), F.lit("0"))
    minus = plain.startswith("-")
    value = F.when(over & minus, F.lit(-9223372036854775808)).when(over, F.lit(9223372036854775807)).when(minus, -size.try_cast("long")).otherwise(size.try_cast("long"))
    return F.when(plain.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), value)


#: Spellings of units.
UNITS = {
    "шт": "шт", "шт.": "шт", "штук": "шт", "штука": "шт", "штуки": "шт",
    "компл": "компл", "компл.": "компл", "к-т": "компл", "комплект": "компл", "комплектов": "компл",
    "м": "м", "м.": "м", "метр": "м", "метров": "м",
    "пог.м": "пог.м", "п.м": "пог.м", "п.м.": "пог.м", "пог. м": "пог.м", "пм": "пог.м",
    "м2": "м²", "м²": "м²", "кв.м": "м²", "кв. м": "м²", "кв.м.": "м²",
    "м3": "м³", "м³": "м³", "куб.м": "м³", "куб. м": "м³", "куб.м.": "м³",
    "кг": "кг", "кг.": "кг",
    "т": "т", "т.": "т", "тн": "т", "тонн": "т",
    "л": "л", "л.": "л", "литр": "л", "литров": "л",
}


def normalized_unit(unit: Column) -> Column:
    """A unit's usual spelling; unknown ones trimmed and lower-cased, null as ''."""
    plain = F.replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), F.lit("ё"), F.lit("е"))
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), plain)


def normalized_name(name: Column) -> Column:
    """White space as single blanks, case folded."""
    return casefold(F.trim(F.regexp_replace(name, r"\s+", " ")))


def without_breaks(text: Column) -> Column:
    """HTML line breaks as blanks, with the emphasis marks that they leave empty; texts without any stay as they are."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", " "), r"\*\*\s*\*\*", " ")
    return F.when(F.lower(text).contains("<br"), F.regexp_replace(plain, r"[ \t]{2,}", " ")).otherwise(text)


def plain_markdown(text: Column) -> Column:
    """Markdown without embedded images, anchors, link targets and escapes, blanks at line ends and over three line ends, trimmed."""
    for pattern, put in ((r"!\[\]\(data:image/[^)]*\)", ""), (r"<a\s+id=\"[^\"]+\"></a>", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\\([.()\\\-\[\]])", "$1"), (r"[ \t]+\n", "\n"), (r"\n{4,}", "\n\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, put)
    return text


def document_number(name: Column) -> Column:
    """The number of a standard that a file's name holds (СП, ГОСТ, ГОСТ Р or СНиП with dotted digits); null without."""
    return F.nullif(F.regexp_extract(name, r"(?iu)(?:^|[^0-9a-zа-яё_])(?:СП|ГОСТ\s*Р?|СНиП)\s*([0-9]+(?:\.[0-9]+)+)", 1), F.lit(""))


def stretches(text: Column, most: int) -> Column:
    """All distinct stretches of 0 to most characters of a text."""
    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
        return F.when(last > 0, found).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array(F.lit("")), *map(of, range(1, most + 1)))


def sanitize(text: Column) -> Column:
    """Without data URIs of 128 and more and base64 runs of 256 and more characters, control characters as blanks, at most
    two blanks and three line ends in a row."""
    out = F.regexp_replace(text, r"data:[\w/+.;=-]*;base64,[A-Za-z0-9+/]{128,}={0,2}", "")
    out = F.regexp_replace(out, r"[A-Za-z0-9+/]{256,}={0,2}", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.regexp_replace(F.regexp_replace(out, " {3,}", "  "), "\n{4,}", "\n\n\n")


def compact(text: Column, limit: int) -> Column:
    """White space as single blanks, cut to limit characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def context_text(text: Column) -> Column:
    """Lines with single blanks and without empty ones; case and digits stay."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_html(html: Column) -> Column:
    """Tags as blanks, the five basic entities, white space as single blanks."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def subject_key(subject: Column) -> Column:
    """A mail subject without reply and forward marks, case folded."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(subject, r"(?i)^\s*((re|fw|fwd|ответ|пересл)\s*:\s*)+", ""), r"\s+", " ")))


def name_family(name: Column) -> Column:
    """A file name case folded, without a copy's number before its extension."""
    return F.trim(F.regexp_replace(F.regexp_replace(casefold(name), r" ?\(\d+\)(\.[^.]*)?$", "$1"), r"\s+", " "))


def noise_name(name: Column) -> Column:
    """Names of under three characters, of a list number, or of under two letters."""
    return (F.length(F.trim(name)) < 3) | name.rlike(r"^\d+\s*[.)]\s") | (F.regexp_count(name, F.lit("[A-Za-zА-Яа-яЁё]")) < 2)


def column_number(letters: Column) -> Column:
    """The number of a spreadsheet column (A is 1)."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


def column_letters(number: Column) -> Column:
    """Letters of a column's number, of any size; none below 1; null for null."""
    def step(s: Column, _: Column) -> Column:
        left = s["left"] - 1
        more = F.struct(F.floor(left / 26).cast("long").alias("left"), F.concat(F.char(65 + F.pmod(left, F.lit(26))), s["out"]).alias("out"))
        return F.when(s["left"] > 0, more).otherwise(s)

    # fourteen letters are beyond a long
    letters = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(number.cast("long").alias("left"), F.lit("").alias("out")), step, lambda s: s["out"])
    return F.when(number.isNotNull(), letters)


# A run of digits with separators, and the years that aren't flagged.
NUMBER_RUN, SEPARATORS, YEARS = r"[0-9][0-9 \x{a0}.,]{2,}[0-9]", r"[ \x{a0}.,]", (1900, 2099)


def ungrounded_numbers(answer: Column, context: Column, most: int = 5) -> Column:
    """The first numbers of four digits or more of an answer that its context doesn't hold, separators aside; years are left out."""
    plain = lambda text: F.regexp_replace(text, SEPARATORS, "")
    runs = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(NUMBER_RUN), F.lit(0))
    year = lambda digits: (F.length(digits) == 4) & digits.cast("int").between(*YEARS)
    lone = F.filter(runs, lambda r: (F.length(plain(r)) >= 4) & ~year(plain(r)) & ~F.contains(plain(F.coalesce(context, F.lit(""))), plain(r)))
    return F.slice(lone, 1, most)


def compact_tokens(text: Column) -> Column:
    """Words of under three characters or with an underscore or slash."""
    return F.filter(tokens(text), lambda t: (F.length(t) < 3) | F.contains(t, F.lit("_")) | F.contains(t, F.lit("/")))


def reading_terms(text: Column) -> Column:
    """Words; a hyphenated compound of letters is followed by its parts, codes and numbers stay whole."""
    parts = lambda t: F.when(t.rlike("^[a-zа-яёı]+(-[a-zа-яёı]+)+$"), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens(text), parts))


def visible_document(name: Column) -> Column:
    """Not an editor's lock or a system's shadow file."""
    return ~name.rlike(r"^(~\$|\.~lock\.|\._)")


def verdict(answer: Column, source: Column) -> Column:
    """NO_DATA without a text; VERIFIED if the source holds the answer, or holds its numbers and 0.35 of its distinct words;
    else HALLUCINATION."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    share = F.size(F.array_intersect(words(answer), words(source))) / F.nullif(F.size(words(answer)), F.lit(0))
    foreign = F.size(F.array_except(numbers(answer), numbers(source))) > 0
    out = F.when(F.coalesce(answer == "", F.lit(True)) | F.coalesce(source == "", F.lit(True)), "NO_DATA").when(F.contains(source, answer), "VERIFIED")
    return out.when(foreign, "HALLUCINATION").when(share >= 0.35, "VERIFIED").otherwise("HALLUCINATION")


def addresses(text: Column) -> Column:
    """Distinct mail addresses of a text, lower case, in order."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def citations(text: Column) -> Column:
    """Distinct numbers of marks such as [2], [1-3] and [1, 4] outside code, in order; ranges in either direction."""
    plain = F.regexp_replace(text, r"(?s)```.*?```|`[^`\n]*`", "")
    marks = F.regexp_extract_all(plain, F.lit(r"\[(\d{1,3}(?:-\d{1,3})?(?:, ?\d{1,3}(?:-\d{1,3})?)*)\]"), F.lit(1))
    ends = lambda p: F.transform(F.split(p, "-"), lambda n: n.cast("int"))
    parts = F.flatten(F.transform(marks, lambda m: F.split(m, ", ?")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.array_min(ends(p)), F.array_max(ends(p)))))))


def binary_garbage(text: Column) -> Column:
    """Two lines over 60 characters with a slash and no blank, or no Cyrillic letter and under three blanks in the first 200
    characters if they are over 80; texts under 40 characters never are."""
    dense = F.size(F.filter(F.split(text, "\n"), lambda x: (F.length(x) > 60) & ~F.contains(x, F.lit(" ")) & F.contains(x, F.lit("/")))) >= 2
    head = F.replace(F.substring(text, 1, 200), F.lit("\n"), F.lit(""))
    opaque = (F.length(head) > 80) & ~head.rlike("[\u0400-\u04ff]") & (F.regexp_count(head, F.lit(" ")) < 3)
    return F.coalesce((F.length(text) >= 40) & (dense | opaque), F.lit(False))


def sheet_rows(question: Column) -> Column:
    """The first sheet that a question names (struct sheet, rows) with its rows after it, in order; rows are null if one of
    them can't be a sheet's, if a range runs backwards or over 32 rows, or without any."""
    sheet = r"(?iu)\b(?:лист(?:е|а|у|ом)?|(?:work)?sheet)\s+(?:\"([^\"\r\n]{1,31})\"|'([^'\r\n]{1,31})'|«([^»\r\n]{1,31})»|([\p{L}\p{N}_-]{1,31})\b)"
    name = F.concat(*(F.regexp_extract(question, sheet, k) for k in range(1, 5)))
    rest = F.regexp_extract(question, sheet + r"([^.?!;]*)", 5)
    one = r"[0-9]+(?:\s*[-–—:]\s*[0-9]+)?"
    lists = F.regexp_extract_all(rest, F.lit(rf"(?iu)\b(?:строк(?:а|и|у|е|ой|ах|ам|ами)?|rows?)\s*(?:№\s*)?({one}(?:\s*(?:,|\bи\b|\band\b)\s*{one})*)"), F.lit(1))
    ranges = F.flatten(F.transform(lists, lambda a: F.regexp_extract_all(a, F.lit(one), F.lit(0))))
    ends = F.transform(ranges, lambda r: F.transform(F.split(r, r"\s*[-–—:]\s*"), lambda n: n.try_cast("long")))
    span = F.transform(ends, lambda e: F.struct(e[0].alias("a"), F.element_at(e, -1).alias("b")))
    fits = F.forall(span, lambda s: F.coalesce(s["a"].between(1, 1048576) & s["b"].between(s["a"], F.least(s["a"] + 31, F.lit(1048576))), F.lit(False)))
    rows = F.array_sort(F.array_distinct(F.flatten(F.transform(span, lambda s: F.sequence(s["a"], s["b"])))))
    return F.struct(F.nullif(name, F.lit("")).alias("sheet"), F.when((F.size(span) > 0) & fits, rows).alias("rows"))
