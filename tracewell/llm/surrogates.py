"""PII surrogates: detected entities get keyed, type-consistent replacements; DataFrame functions only.

One pattern finds entities; equal entities (compared in lower case, tokens as written) share one surrogate over the whole corpus.
Names are replaced part by part: a family name has one surrogate in all mentions, and so has a first name of a gender, so
"Mrs Ann Smith", "Mrs Smith" and "Ann Smith" still refer to one person and other persons stay apart. Surrogates keep the
format (separators, digit and letter places, capitals, top-level domain, Luhn validity), the script and, for first names, the
gender. Collision checks in rounds: a surrogate that equals another one's, or a real entity of the corpus (but for first
names, which tell nothing alone), is drawn anew, until all are distinct.

A name is found after a title or by a listed first name; without both, no pattern tells a name from another capital word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import stage

KEY = "surrogate-key-1"
MAX_ROUNDS = 32

# Titles by gender, first names by gender and script, syllables of made-up family names by script.
TITLES = {
    "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora"),
    "male": ("Mr", "Herr", "Monsieur", "Señor"),
}
FIRST_NAMES = {
    ("female", "latin"): ("Alice", "Clara", "Diana", "Elena", "Frida", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nadia"),
    ("male", "latin"): ("Albert", "Bruno", "Carlos", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Louis", "Martin"),
    ("female", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Ольга"),
    ("male", "cyrillic"): ("Антон", "Борис", "Виктор", "Григорий", "Иван", "Олег"),
}
SYLLABLES = {
    "latin": ("bar", "cor", "del", "fen", "gor", "hal", "kem", "lor", "mon", "ned", "pol", "rud", "sel", "tov", "ves", "zan"),
    "cyrillic": ("бар", "вол", "гор", "дан", "кор", "лев", "мир", "нов", "пол", "род", "сев", "тар", "фед", "хор", "чер", "юр"),
    "greek": ("βαρ", "γορ", "δελ", "θεν", "καλ", "λορ", "μιρ", "νεδ", "παλ", "ρον", "σελ", "ταρ", "φεν", "χορ"),
    "armenian": ("բար", "գոր", "դան", "կոր", "լեւ", "միր", "նով", "պող", "սեւ", "տար"),
}

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for u in ts for t in (u, u.upper())) + r")\b\.?"
_FIRST = "(?:" + "|".join(n for ns in FIRST_NAMES.values() for n in ns) + ")"
_NAME = r"\p{Lu}\p{L}{1,30}"
# Heads of access keys.
_KEY_HEADS = "sk-|pk_|sk_|rk_|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|npm_|hf_"
#: Type -> pattern, in the order in which they are tried at a place. Repetitions are bounded, so long texts stay linear.
PATTERNS = {
    "EMAIL": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "SECRET": r"(?<![0-9A-Za-z])(?=[A-Fa-f]{0,31}[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "TOKEN": rf"(?<![0-9A-Za-z])(?:(?:{_KEY_HEADS})[0-9A-Za-z_-]{{12,}}+|eyJ[0-9A-Za-z_-]{{8,}}+\.[0-9A-Za-z_-]{{8,}}+\.[0-9A-Za-z_-]{{8,}}+)",
    "PHONE": r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "IP": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "CARD": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "NAME": rf"(?<!\p{{L}})(?:{_TITLE} {_NAME}(?: {_NAME})?|{_FIRST} {_NAME})(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes.
HINT = rf"[0-9@]|{_TITLE} |{_FIRST} |eyJ|{_KEY_HEADS}"


def entity_type(raw: Column) -> Column:
    kinds = list(PATTERNS.items())
    chain = F.when(raw.rlike(f"^(?:{kinds[0][1]})$"), F.lit(kinds[0][0]))
    for name, pattern in kinds[1:]:
        chain = chain.when(raw.rlike(f"^(?:{pattern})$"), F.lit(name))
    return chain.otherwise(F.lit("CARD"))


def _digits(hex_: Column, i: Column, width: int = 4) -> Column:
    """A number from `width` hex digits at place i of a digest, read cyclically."""
    at = F.pmod(i * width, F.length(hex_) - width) + 1
    return F.conv(F.substring(hex_, at, F.lit(width)), 16, 10).cast("int")


def _pick(values, hex_: Column, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(_digits(hex_, i), F.lit(len(values))) + 1)


def _luhn(digits: Column) -> Column:
    """Sum of a digit array under the Luhn rule, the last digit counted once."""
    n = F.size(digits)

    def weigh(d: Column, i: Column) -> Column:
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(F.pmod(n - 1 - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, x: a + x)


def _shuffled_characters(norm: Column, hex_: Column, keep_from: Column | None = None) -> Column:
    """Digits and ASCII letters drawn anew place by place in their case; other characters, and all from keep_from on, stay."""

    def one(c: Column, i: Column) -> Column:
        drawn = (
            F.when(c.rlike("^[0-9]$"), F.pmod(_digits(hex_, i), F.lit(10)).cast("string"))
            .when(c.rlike("^[a-z]$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(_digits(hex_, i), F.lit(26)) + 1, F.lit(1)))
            .when(c.rlike("^[A-Z]$"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(_digits(hex_, i), F.lit(26)) + 1, F.lit(1)))
            .otherwise(c)
        )
        return drawn if keep_from is None else F.when(i >= keep_from, c).otherwise(drawn)

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _card(norm: Column, hex_: Column) -> Column:
    """Digits drawn anew with the last one set so that the Luhn check comes out as for the original."""
    numbers = lambda s: F.transform(F.split(F.regexp_replace(s, "[^0-9]", ""), ""), lambda c: c.cast("int"))
    body = _shuffled_characters(F.expr("substring(norm, 1, length(norm) - 1)"), hex_)
    valid = F.pmod(_luhn(numbers(norm)), F.lit(10)) == 0
    last = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(numbers(body), F.array(F.lit(0)))), F.lit(10)), F.lit(10))
    return F.concat(body, F.when(valid, last).otherwise(F.pmod(last + 1, F.lit(10))).cast("string"))


def name_parts(raw: Column) -> Column:
    """array<struct<kind, norm, raw>> of a NAME: titles (kind null) stay, then first names of a gender, then family names."""
    words = F.split(raw, " ")
    lower = lambda values: [v.lower() for v in values]
    bare = F.regexp_replace(F.lower(F.get(words, 0)), "\\.$", "")
    titles = {g: bare.isin(lower(ts)) for g, ts in TITLES.items()}
    titled = titles["female"] | titles["male"]
    last = F.size(words) - 1

    def one(w: Column, i: Column) -> Column:
        kind = F.when(titled & (i == 0), F.lit(None).cast("string")).when(i == last, "FAMILY")
        for gender in TITLES:
            listed = F.lower(w).isin([n.lower() for (g, _), ns in FIRST_NAMES.items() if g == gender for n in ns])
            kind = kind.when(F.when(titled, titles[gender]).otherwise(listed), f"FIRST_{gender}")
        return F.struct(kind.otherwise("FAMILY").alias("kind"), F.lower(w).alias("norm"), w.alias("raw"))

    return F.transform(words, one)


def entity_parts(raw: Column) -> Column:
    """array<struct<kind, norm, raw>> of what is replaced in one match."""
    kind = entity_type(raw)
    whole = F.array(F.struct(kind.alias("kind"), F.when(kind == "TOKEN", raw).otherwise(F.lower(raw)).alias("norm"), raw.alias("raw")))
    return F.when(kind == "NAME", name_parts(raw)).otherwise(whole)


def _script(word: Column) -> Column:
    chain = F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic")
    for script in ("greek", "armenian"):
        chain = chain.when(word.rlike(f"\\p{{Is{script.title()}}}"), script)
    return chain.otherwise("latin")


def _family(norm: Column, hex_: Column, attempt: Column) -> Column:
    """Made-up syllables of the name's script, three and one more each attempt, so that the names to draw from grow manifold."""
    places = F.sequence(F.lit(0), F.lit(2) + attempt)
    chain = F.when(F.lit(False), "")
    for script, values in SYLLABLES.items():
        chain = chain.when(_script(norm) == script, F.array_join(_picks(values, hex_, places), ""))
    return chain


def _picks(values, hex_: Column, places: Column) -> Column:
    return F.transform(places, lambda k: _pick(values, hex_, k + 2))


def _first(gender: str, norm: Column, hex_: Column, attempt: Column) -> Column:
    """A listed first name of the gender and script (Latin, where it has none); a double name in the second attempt, and so on."""
    made = {x: F.lower(F.array_join(_picks(FIRST_NAMES[gender, x], hex_, F.sequence(F.lit(0), attempt)), "-")) for x in ("cyrillic", "latin")}
    return F.when(_script(norm) == "cyrillic", made["cyrillic"]).otherwise(made["latin"])


def surrogate(kind: Column, norm: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement (lower case, but for tokens) of entity `norm`; norm must be the column of that name."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm)
    hex_ = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256))
    hexa = F.array_join(
        F.transform(F.split(norm, ""), lambda c, i: F.substring(hex_, F.pmod(i, F.lit(128)) + 1, F.lit(1))), ""
    )
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_digits(hex_, i), F.lit(254)) + 1).cast("string")), ".")
    tld = F.length(norm) - F.length(F.substring_index(norm, ".", -1)) - 1
    country = F.length(F.regexp_extract(norm, r"^\+\d{1,3}(?=\D)", 0))
    head = F.length(F.regexp_extract(norm, f"^(?:{_KEY_HEADS}|eyJ)", 0))
    phone = F.concat(F.substring(norm, F.lit(1), country), _shuffled_characters(F.substring(norm, country + 1, F.length(norm)), hex_))
    return (
        F.when(kind == "EMAIL", _shuffled_characters(norm, hex_, tld))
        .when(kind == "SECRET", hexa)
        .when(kind == "PHONE", phone)
        .when(kind == "IP", octets)
        .when(kind == "TOKEN", F.concat(F.substring(norm, F.lit(1), head), _shuffled_characters(F.substring(norm, head + 1, F.length(norm)), hex_)))
        .when(kind == "FAMILY", _family(norm, hex_, attempt))
        .when(kind == "FIRST_female", _first("female", norm, hex_, attempt))
        .when(kind == "FIRST_male", _first("male", norm, hex_, attempt))
        .otherwise(_card(norm, hex_))
    )


def assign_surrogates(entities: DataFrame, key: str = KEY, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Distinct entities(kind, norm) -> kind, norm, surrogate (lower case, but for tokens), stored; all surrogates of a kind are distinct and none is an
    entity of it (a first name may be).

    Each round draws for the entities left, keeps the smallest claimant of a free surrogate and stages both parts;
    rounds end when none is left (collisions are rare, so mostly after one). Raises after max_rounds."""
    real = entities.filter(~F.col("kind").startswith("FIRST_")).select(F.col("kind").alias("r_kind"), F.col("norm").alias("r_norm"))
    left, taken = entities.select("kind", "norm"), None
    for attempt in range(max_rounds):
        drawn = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        free = first.join(real, (F.col("kind") == F.col("r_kind")) & (F.col("surrogate") == F.col("r_norm")), "left_anti")
        if taken is not None:
            used = taken.select(F.col("kind").alias("u_kind"), F.col("surrogate").alias("u_surrogate"))
            free = free.join(used, (F.col("kind") == F.col("u_kind")) & (F.col("surrogate") == F.col("u_surrogate")), "left_anti")
        kept = stage(free.select("kind", "norm", "surrogate"), "surrogates")
        taken = kept if taken is None else taken.unionByName(kept)
        left = stage(left.join(kept.select("kind", "norm"), ["kind", "norm"], "left_anti"), "surrogates-left")
        if left.isEmpty():
            return taken
    raise ValueError("some entities found no free surrogate")


def _as_written(raw: Column, made: Column) -> Column:
    """The surrogate in the capitals of the entity: all, initial, or none."""
    return (
        F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(made))
        .when(raw.rlike("^\\p{Lu}\\p{Ll}"), F.initcap(made))
        .otherwise(made)
    )


def pseudonymize(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (whole, with surrogates), n_entities for every row.

    Null texts stay null with 0 entities; repeated rows get equal results; null ids are carried along. Texts are stored once with
    their matches, so that each is searched once. Distinct parts of entities meet their surrogates before they return to
    their texts, hot ones aggregated; texts with entities are shuffled by row, the others never."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    none = F.array().cast("array<string>")
    found = F.when(hinted, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(none)
    searched = stage(rows.withColumn("matches", found).withColumn("uid", F.monotonically_increasing_id()), "pii-texts")
    marked = searched.filter(F.size("matches") > 0)
    each = marked.select("uid", F.explode(F.array_distinct(F.flatten(F.transform("matches", entity_parts)))).alias("part"))
    each = stage(each.select("uid", "part.kind", "part.norm").filter("kind is not null").distinct(), "pii-entities")
    table = assign_surrogates(stage(each.select("kind", "norm").distinct(), "pii-distinct"), key)
    name = F.concat_ws("|", "kind", "norm")
    replaced = each.join(table, ["kind", "norm"]).select("uid", name.alias("name"), "surrogate")
    maps = replaced.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("name", "surrogate"))).alias("swap"))

    def written(part: Column) -> Column:
        made = F.element_at("swap", F.concat_ws("|", part["kind"], part["norm"]))
        return F.when(part["kind"].isNull(), part["raw"]).when(part["kind"] == "TOKEN", made).otherwise(_as_written(part["raw"], made))

    def renamed(match: Column) -> Column:
        return F.array_join(F.transform(entity_parts(match), written), " ")

    pieces = F.split("text", PATTERN, -1)
    changed = F.array_join(F.zip_with(pieces, F.transform("matches", renamed), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    with_entities = marked.join(maps, "uid").select("doc_id", changed.alias("text"), F.size("matches").cast("long").alias("n_entities"))
    without = searched.filter(F.size("matches") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    return without.unionByName(with_entities)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
