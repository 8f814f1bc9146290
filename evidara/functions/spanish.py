"""Spanish words to stems, by the published suffix rules of the Snowball project, as columns.

Every stage is a column of its own, so no expression holds another twice. Regions: R1 follows the first consonant after a vowel, R2 the same within R1; RV follows
the next vowel if the second letter is a consonant, the next consonant if the first two letters are vowels, else the third letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vowels; suffixes of each step, in groups that are treated alike.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "iéndo ándo ár ér ír iendo ando ar er ir".split()
PLAIN_SUFFIXES = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
IC_SUFFIXES = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
REPLACED = {"log": "logía logías".split(), "u": "ución uciones".split(), "ente": "encia encias".split()}
IDAD, IVA = "idad idades".split(), "iva ivo ivas ivos".split()
Y_SUFFIXES = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
GU_SUFFIXES = "en es éis emos".split()
VERB_SUFFIXES = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL, RESIDUAL_E = "os a o á í ó".split(), "e é".split()
#: Words that carry no content.
STOP = frozenset(
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese "
    "eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros".split()
)


def _any(suffixes: list[str]) -> str:
    return "(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$"


def _in(column: Column, values: list[str]) -> Column:
    return column.isin(*values)


def _cut(word: Column, n: Column | int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _stage(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column as a generated one: filters stay above it, so the optimizer never writes one stage into another (which would double the expression each time)."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """The frame with the stem of each (lower-case) word."""
    v = f"[{VOWELS}]"
    c = f"[^{VOWELS}]"
    region = f"^{c}*{v}+{c}"
    n = F.length(F.col(word))
    upto = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 0))
    or_all = lambda x: F.when(x > 0, x).otherwise(n)
    df = _stage(words, "_r1", or_all(upto(F.col(word), region)))
    inner = upto(F.substr(F.col(word), F.col("_r1") + 1), region)
    df = _stage(df, "_r2", F.when(inner > 0, F.col("_r1") + inner).otherwise(n))
    rv = F.when(F.col(word).rlike(f"^.{c}"), or_all(upto(F.col(word), f"^.{c}+{v}"))).when(F.col(word).rlike(f"^{v}{v}"), or_all(upto(F.col(word), f"^{v}+{c}"))).otherwise(F.least(n, F.lit(3)))
    df = _stage(df, "_rv", rv)
    long = lambda base, mark: F.length(base) >= F.col(mark)
    # attached pronouns
    df = _stage(df, "_p", F.regexp_extract(F.col(word), _any(PRONOUNS), 1))
    df = _stage(df, "_b", _cut(F.col(word), F.length("_p")))
    df = _stage(df, "_f", F.regexp_extract(F.col("_b"), _any(BEFORE_PRONOUN), 1))
    mine = (F.col("_p") != "") & (F.col("_f") != "") & (F.length("_b") - F.length("_f") >= F.col("_rv"))
    after_u = (F.col("_p") != "") & F.col("_b").rlike("uyendo$") & (F.length("_b") - 5 >= F.col("_rv"))
    df = _stage(df, "_w", F.when(mine & F.col("_f").rlike("[áéí]"), F.concat(_cut(F.col("_b"), F.length("_f")), F.translate("_f", "áéí", "aei"))).when(mine | after_u, F.col("_b")).otherwise(F.col(word)))
    # standard suffixes
    replaced = [x for xs in REPLACED.values() for x in xs]
    df = _stage(df, "_s", F.regexp_extract("_w", _any([*PLAIN_SUFFIXES, *IC_SUFFIXES, *replaced, "amente", "mente", *IDAD, *IVA]), 1))
    df = _stage(df, "_b", _cut(F.col("_w"), F.length("_s")))
    end = F.when(_in(F.col("_s"), IC_SUFFIXES), F.regexp_extract("_b", "(ic)$", 1)).when(F.col("_s") == "amente", F.regexp_extract("_b", "(iv|os|ic|ad)$", 1)).when(F.col("_s") == "mente", F.regexp_extract("_b", "(ante|able|ible)$", 1))
    end = end.when(_in(F.col("_s"), IDAD), F.regexp_extract("_b", "(abil|ic|iv)$", 1)).when(_in(F.col("_s"), IVA), F.regexp_extract("_b", "(at)$", 1)).otherwise("")
    df = _stage(df, "_e", end)
    df = _stage(df, "_e", F.when(F.length("_b") - F.length("_e") >= F.col("_r2"), F.col("_e")).otherwise(""))
    df = _stage(df, "_c", _cut(F.col("_b"), F.length("_e")))
    ativ = (F.col("_s") == "amente") & (F.col("_e") == "iv") & F.endswith(F.col("_c"), F.lit("at")) & (F.length("_c") - 2 >= F.col("_r2"))
    df = _stage(df, "_c", F.when(ativ, _cut(F.col("_c"), 2)).otherwise(F.col("_c")))
    gone = F.when(F.col("_s") == "", False).when(F.col("_s") == "amente", long(F.col("_b"), "_r1")).otherwise(long(F.col("_b"), "_r2"))
    df = _stage(df, "_done", gone)
    made = F.col("_c")
    for new, olds in REPLACED.items():
        made = F.when(_in(F.col("_s"), olds), F.concat("_b", F.lit(new))).otherwise(made)
    df = _stage(df, "_w", F.when(F.col("_done"), made).otherwise(F.col("_w")))
    # verb suffixes, those with y first
    in_rv = lambda suffixes: F.regexp_extract(F.substr(F.col("_w"), F.col("_rv") + 1), _any(suffixes), 1)
    df = _stage(df, "_s", F.when(F.col("_done"), "").otherwise(in_rv(Y_SUFFIXES)))
    df = _stage(df, "_b", _cut(F.col("_w"), F.length("_s")))
    df = _stage(df, "_y", (F.col("_s") != "") & F.endswith(F.col("_b"), F.lit("u")))
    df = _stage(df, "_w", F.when(F.col("_y"), F.col("_b")).otherwise(F.col("_w")))
    df = _stage(df, "_s", F.when(F.col("_done") | F.col("_y"), "").otherwise(in_rv([*GU_SUFFIXES, *VERB_SUFFIXES])))
    df = _stage(df, "_b", _cut(F.col("_w"), F.length("_s")))
    df = _stage(df, "_w", F.when(_in(F.col("_s"), GU_SUFFIXES) & F.endswith(F.col("_b"), F.lit("gu")), _cut(F.col("_b"), 1)).otherwise(F.col("_b")))
    # what is left
    df = _stage(df, "_s", in_rv([*RESIDUAL, *RESIDUAL_E]))
    df = _stage(df, "_b", _cut(F.col("_w"), F.length("_s")))
    gu = _in(F.col("_s"), RESIDUAL_E) & F.endswith(F.col("_b"), F.lit("gu")) & (F.length("_b") - 1 >= F.col("_rv"))
    return _stage(df, stem, F.translate(F.when(gu, _cut(F.col("_b"), 1)).otherwise(F.col("_b")), "áéíóú", "aeiou")).select(*words.columns, stem)
