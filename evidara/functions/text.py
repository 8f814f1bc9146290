"""Text functions over columns: normalisation, folds, sentences, dates, redaction."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the letters that they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
#: Spanish month names and numbers.
MONTHS = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06", "julio": "07", "agosto": "08",
    "septiembre": "09", "setiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12",
}


#: Latin letters with one mark (U+00C0 to U+017F) and the pairs of letter and mark that they are composed of.
COMPOSED = [(unicodedata.normalize("NFD", c), c) for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) == 2]


def compose(text: Column) -> Column:
    """Latin letters followed by a combining mark as one character; texts without marks are not touched. Other scripts stay as they are."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in COMPOSED])
    return F.when(text.rlike("[\u0300-\u036f]"), F.aggregate(pairs, text, lambda t, p: F.replace(t, p["a"], p["b"]))).otherwise(text)


def repair(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 read anew; texts that show no sign of it, or would not be valid, stay as they are."""
    sign = text.rlike("[\u00c2\u00c3][\u0080-\u00bf]") & ~text.rlike("[^\u0000-\u00ff]")
    again = F.encode(F.when(sign, text), "ISO-8859-1").cast("string")
    return F.when(sign & F.is_valid_utf8(again), again).otherwise(text)


#: Letters that UTF-8 read as Latin-1 begins with.
MISREAD = ("Ã", "Â", "â")


def repaired(text: Column) -> Column:
    """``repair`` up to twice, for texts that were misread twice: each pass must be valid UTF-8 and leave fewer of the letters that give such texts away."""

    def one(x):
        told = F.lit(False)
        for mark in MISREAD:
            told = told | F.contains(x, F.lit(mark))
        again = F.encode(F.when(told & ~x.rlike("[^\u0000-\u00ff]"), x), "ISO-8859-1").cast("string")
        signs = lambda y: F.length(y) - F.length(F.translate(y, "ÃÂ", ""))
        return F.get(F.transform(F.array(again), lambda y: F.when(F.is_valid_utf8(y) & (signs(y) < signs(x)), y).otherwise(x)), F.lit(0))

    # each pass is bound once, however often it looks at its text
    return F.get(F.transform(F.transform(F.array(text), one), one), F.lit(0))


def golden_value(value: Column, field: str = "") -> Column:
    """A field as golden values are compared: repaired, folded, without marks, single blanks; codes are letters and digits alone, titles have no end marks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(fold(repaired(value)), r"\p{Mn}", ""), r"\s+", " "))
    return {"document_code": F.regexp_replace(plain, r"[^\p{L}\p{N}]", ""), "title": F.regexp_replace(plain, "[ .:;]+$", "")}.get(field, plain)


def slug(text: Column) -> Column:
    """Folded letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def safe_path(path: Column) -> Column:
    """Whether a path is relative, without parent steps, backslashes or drive letters."""
    return F.coalesce((path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)"), F.lit(False))


def sidecar(path: Column, suffix: str) -> Column:
    """The path with its extension replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def in_context(prefix: Column, text: Column) -> Column:
    """The text below its prefix, if there is one."""
    return F.concat_ws("\n", F.when(prefix != "", prefix), text)


def form_labels(text: Column) -> Column:
    """Labels before a blank to fill in (Label: ____), in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([^:\n|*_]{2,60}):[ \t]*_{2,}"), F.lit(1)), lambda x: F.trim(x))


def fold(text: Column) -> Column:
    """Lower case without accents; ß is ss."""
    return F.replace(F.lower(F.translate(text, ACCENTED, PLAIN)), F.lit("ß"), F.lit("ss"))


def fold_key(text: Column) -> Column:
    """fold with _ and - as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(fold(text), "_-", "  "), r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Composed letters (see compose); then control characters go, then line ends, hyphenated line breaks between Latin letters, runs of blanks, blanks around line
    ends, more than two line ends, and blanks at both ends."""
    out = F.regexp_replace(compose(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"([A-Za-zÀ-ÖØ-öø-ÿ])-\n([A-Za-zÀ-ÖØ-öø-ÿ])", "$1$2")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def remove_spans(text: Column, spans: Column) -> Column:
    """Each span's first remaining occurrence removed, one after the other."""
    return F.aggregate(
        spans, text,
        lambda a, s: F.when((F.instr(a, s) > 0) & (F.length(s) > 0), F.concat(F.substr(a, F.lit(1), F.instr(a, s) - 1), F.substr(a, F.instr(a, s) + F.length(s)))).otherwise(a),
    )


def sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space, or between blank lines; trimmed, empty ones left out."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n\s*\n")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def words(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.array_remove(F.split(fold(text), "[^a-z0-9]+"), "")


def spanish_date(text: Column) -> Column:
    """ISO text of a day-first Spanish date (or year and month alone), empty if none. The calendar is not checked."""
    s = F.regexp_replace(F.regexp_replace(fold(text), r"\s+", " "), r"^[ .,:;]+|[ .,:;]+$", "")
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    name = "(" + "|".join(MONTHS) + ")"
    get = lambda pattern, i: F.regexp_extract(s, pattern, i)
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    iso, short = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    long, days, ym = rf"^(\d{{1,2}}) de {name} de (\d{{4}})$", rf"^(\d{{1,2}}) dias? del mes de {name} de (\d{{4}})$", rf"^{name},? (\d{{4}})$"
    year = F.when(F.length(get(short, 3)) == 2, F.concat(F.lit("20"), get(short, 3))).otherwise(get(short, 3))
    written = lambda p: F.concat_ws("-", get(p, 3), month[get(p, 2)], two(get(p, 1)))
    return (
        F.when(s.rlike(iso), F.concat_ws("-", get(iso, 1), two(get(iso, 2)), two(get(iso, 3))))
        .when(s.rlike(short), F.concat_ws("-", year, two(get(short, 2)), two(get(short, 1))))
        .when(s.rlike(long), written(long))
        .when(s.rlike(days), written(days))
        .when(s.rlike(ym), F.concat_ws("-", get(ym, 2), month[get(ym, 1)]))
        .otherwise("")
    )


def redact(text: Column, limit: int = 256) -> Column:
    """Values of secret-looking names replaced, to the quote that they open with or the next white space, then cut to a length with an ellipsis."""
    out = F.regexp_replace(text, r"(token|password|secret|api_key)(\s*=\s*)(?:\"[^\"]*\"?|[^\s\"]+)", "$1$2[redacted]")
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("..."))).otherwise(out)


def page_spec(spec: Column) -> Column:
    """1-3,5 as the array 1, 2, 3, 5."""
    one = lambda x: F.sequence(F.element_at(F.split(x, "-"), 1).cast("int"), F.element_at(F.split(x, "-"), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), one))))


#: Keys whose values never leave, endings of such keys, keys of stored provider responses, and what a signed URL looks like.
SENSITIVE = (
    "api_key", "authorization", "body", "chunk_text", "content", "credential", "document_text", "markdown", "password", "payload", "prompt", "raw", "raw_text", "request_body", "response", "secret", "signed_url", "text", "token",
    "url", "value_raw",
)
SENSITIVE_ENDS = ("_body", "_content", "_markdown", "_payload", "_text", "_url")
PAYLOAD_KEYS = ("api_key", "token", "authorization", "signed_url", "url")
SIGNED_URL = r"(?i)https?://\S*(?:signature|x-amz-signature|x-goog-signature|token|auth|sig)=\S*"
REDACTED = "***redacted***"


def sanitize(value: Column, key: Column | str = "", limit: int = 256) -> Column:
    """A value as a log may hold it: nothing of sensitive keys or with a signed URL, the first ``limit`` characters (an ellipsis included) of the rest."""
    name = F.lower(F.lit(key) if isinstance(key, str) else key)
    secret = name.isin(*SENSITIVE) | name.rlike("(?:" + "|".join(SENSITIVE_ENDS) + ")$") | value.rlike(SIGNED_URL)
    cut = F.when(F.length(value) <= limit, value).otherwise(F.concat(F.substring(value, 1, limit - 3), F.lit("...")))
    return F.when((value != "") & F.coalesce(secret, F.lit(False)), F.lit(REDACTED)).otherwise(cut)


def preview(values: Column, key: Column | str = "", items: int = 8) -> Column:
    """The first items of an array, each as ``sanitize`` leaves it, and how many more there are."""
    shown = F.transform(F.slice(values, 1, items), lambda x: sanitize(x, key))
    return F.when(F.size(values) > items, F.concat(shown, F.array(F.concat(F.lit("...(+"), (F.size(values) - items).cast("string"), F.lit(" more)"))))).otherwise(shown)


def error_text(text: Column) -> Column:
    """An error's text without URLs and absolute paths."""
    bare = F.regexp_replace(F.regexp_replace(text, SIGNED_URL, REDACTED), r"(?i)https?://\S+", REDACTED)
    # a path is a root (of a drive, a share or the file system) and what follows it up to white space or a quote, two characters at least
    root = "|".join((r"\b[A-Za-z]:[\\/]", r"\\\\", "/"))
    return F.regexp_replace(bare, rf"(?:{root})[^\s'\"][^\s'\"]+", REDACTED)


def redact_json(payload: Column) -> Column:
    """A provider's JSON response with the values of its secret keys, and all strings that are URLs, replaced. Objects and arrays of secret keys stay."""
    string = r'"(?:[^"\\]|\\.)*+"'
    keyed = F.regexp_replace(payload, r'(?i)("(?:' + "|".join(PAYLOAD_KEYS) + r')"\s*:\s*)(?:' + string + r"|-?[0-9][0-9.eE+-]*|true|false|null)", f'$1"{REDACTED}"')
    return F.regexp_replace(keyed, r'(?i)"https?://(?:[^"\\]|\\.)*+"(?!\s*:)', f'"{REDACTED}"')


#: What the labels of form fields begin with, further whole labels, and words that forms announce themselves with.
LABEL_STARTS = ("nombre", "cargo", "documento", "descripcion", "firma", "telefono", "correo", "proyecto", "celular")
LABELS = (*LABEL_STARTS, "fecha", "area", "testigo", "documento de identidad", "correo electronico")
FORM_WORDS = ("formato", "formulario", "diligencie", "datos de la persona")


def is_label(line: Column) -> Column:
    """Whether a line is the label of a form field: a known one, or one that begins with a known word, with a colon at its end."""
    bare = F.regexp_replace(F.lower(normalize_text(line)), ":+$", "")
    return F.coalesce(F.trim(line).endswith(":") & (bare.isin(*LABELS) | bare.rlike("^(?:" + "|".join(LABEL_STARTS) + ") ")), F.lit(False))


def has_form_signal(text: Column) -> Column:
    low = F.lower(normalize_text(text))
    found = F.lit(False)
    for word in FORM_WORDS:
        found = found | F.contains(low, F.lit(word))
    return F.coalesce(found, F.lit(False))
