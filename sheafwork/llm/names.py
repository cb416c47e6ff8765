"""Links between spellings of one person or one employer within a batch, by metric-space partitioning.

Each value is reduced to strings in plain Latin letters: the surname of a person; of a firm its own words, these with the trade, and its initials. The strings
of one batch and one role live in the metric space of the Levenshtein distance. Pivots are taken from them; a string belongs to the cell of
its nearest pivot and is replicated, by the triangle inequality, to every cell whose pivot is at most twice its radius
farther, so that an exact radius join inside the cells loses no pair. Initials are joined in the same way with radius 0. Pairs of values in reach are then verified on the
whole name: given names, initials and nicknames, or the trade and abbreviations of a firm. Pairs that only share a link are verified once more with one edit more.
"""

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .language import plain
from .personal import FILE_WORDS, TITLES

#: Strings for each pivot of a batch, most pivots of a batch, and strings of a batch above which they meet by shared shorter strings only.
PER_PIVOT, MOST_PIVOTS, DENSE = 256, 16, 1024

# Latin spelling of Cyrillic letters.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".split()))
CYRILLIC = {ord(k): v.replace("-", "") for k, v in CYRILLIC.items()}

# Short and pet forms of given names, as "form: names".
NICKNAMES = """
andy: andrew andreas
drew: andrew
bill: william
billy: william
will: william
liam: william
mike: michael
mick: michael
mickey: michael
tom: thomas
tommy: thomas
sam: samuel
sammy: samuel
ollie: oliver
noll: oliver
rob: robert roberto
bob: robert
bobby: robert
bert: robert
rick: richard
dick: richard
rich: richard
richie: richard
ted: theodore edward
teddy: theodore
theo: theodore
liz: elizabeth elisabeth
lizzie: elizabeth
beth: elizabeth
betty: elizabeth
eliza: elizabeth
lisa: elisabeth elizabeth
elli: elisabeth
vicky: victoria
tori: victoria
maggie: margaret
peggy: margaret
meg: margaret
kate: katherine
kathy: katherine katharina
katie: katherine
kathi: katharina
kati: katharina
kaethe: katharina
jen: jennifer
jenny: jennifer
becky: rebecca
becca: rebecca
hannes: johannes
hans: johannes
jo: josephine johannes
fritz: friedrich
wolf: wolfgang
matze: matthias
matti: matthias
basti: sebastian
seba: sebastian
sebi: sebastian
uli: ulrike
grete: margarete
gretel: margarete
jogi: joerg jorg
joschi: jorg
ginette: genevieve
steph: stephane
fred: frederic friedrich
max: maximilien maximilian
ben: benoit benjamin
fran: francois francisco
lulu: luis
beto: roberto
bia: beatriz
joaozinho: joao
toninho: antonio
tonio: antonio
chica: francisca
chico: francisco
nanda: fernanda
sao: conceicao
concha: concepcion
conchita: concepcion
lola: dolores
lolita: dolores
merche: mercedes
lupe: guadalupe
paco: francisco
pancho: francisco
pepe: jose
chucho: jesus
suso: jesus
nacho: ignacio
chema: jose
katya: ekaterina
dima: dmitriy
mitya: dmitriy
sasha: aleksandr
tanya: tatyana
natasha: natalya
kolya: nikolay
vova: vladimir
volodya: vladimir
zhenya: evgeniy
masha: mariya
olya: olga
nastya: anastasiya
lesha: aleksey
alesha: aleksey
celia: celine
lodie: elodie
"""
_FORMAL: dict[str, frozenset[str]] = {a: frozenset(b.split()) for a, b in (line.split(": ") for line in NICKNAMES.strip().splitlines())}

# Legal forms, trades with their abbreviations (a trade in another language is the same trade), values that name no firm.
LEGAL = "ltd limited inc incorporated corp llc plc co company gmbh gesellschaft mbh ag aktiengesellschaft kg ohg sa sl sarl sas sociedad anonima limitada ltda eireli group grp gruppe ooo oao zao ao obshchestvo".split()
TRADES = """
brewing brew brewery brw
logistics logist log logistika lgst
engineering eng engg engin
utilities util utl utils
ceramics ceram cer keramika crm
dairy dry dair
hardware hdw hardw hrdw
foods fds food produkty prod
textiles tex text textile tekstil txt
retail rtl ret
voyages voy voyage vyg
instruments instr inst instrument pribory
automation autom auto stanki aut
packaging pkg pack packag upakovka
marine mar mrn
staffing staff stf stfg
"""
_TRADE = {form: forms.split()[0] for forms in TRADES.strip().splitlines() for form in forms.split()}
# Machine tools are a trade of their own.
_TRADE["stanki"] = "stanki"
NOBODY = frozenset("freelance freelancer selbstandig selbststandig independent independant autonomo autonoma self employed selfemployed private privat various divers na none unknown sole trader samozanyatyy frilans own business".split())

_TITLE = re.compile(rf"^(?:(?:{TITLES})\.?\s+)+(?=\S)", re.I)
_FILE = re.compile(rf"(?<![^\W\d_])(?:{FILE_WORDS})(?![^\W\d_])", re.I)
_CONTACT = re.compile(r"\s*[|/;<(].*$|,\s+(?=\S*[@\d+(]).*$")
_INITIAL = re.compile(r"^[^\W\d_]\.?$")


def fold(text: str) -> str:
    """Lower-case Latin letters without accents."""
    low = unicodedata.normalize("NFC", text.lower()).translate(CYRILLIC).replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def person(value: str | None) -> tuple[str, str, str] | None:
    """(surname, given name, initials of middle names) in folded letters; None for what names nobody."""
    if not value:
        return None
    text = _TITLE.sub("", _CONTACT.sub("", plain(value)).strip())
    if not text or _FILE.search(text) or any(c.isdigit() or c in "_@" for c in text):
        return None
    head, comma, tail = text.partition(",")
    if comma and tail.strip():
        last, first = head.split(), tail.split()
    else:
        words = head.split()
        caps = [w for w in words if len(w) > 2 and w.isupper() and "." not in w]
        if len(words) < 2:
            return None
        if caps and len(caps) < len([w for w in words if not _INITIAL.match(w)]):
            last, first = caps, [w for w in words if w not in caps]
        elif _INITIAL.match(words[-1]):
            last = [w for w in words if not _INITIAL.match(w)]
            first = [w for w in words if _INITIAL.match(w)]
        else:
            first, last = words[:1], words[1:]
            while len(last) > 1 and (_INITIAL.match(last[0]) or re.search(r"(?:вич|вна|ична)$", last[0].lower())):
                first.append(last.pop(0))
    names = [re.sub(r"[^a-z]", "", fold(w)) for w in first]
    names = [w for w in names if w]
    surname = re.sub(r"[^a-z]", "", fold("".join(last)))
    if not surname or not names:
        return None
    return surname, names[0], "".join(w[0] for w in names[1:])


def firm(value: str | None) -> tuple[str, str, str] | None:
    """(own words, trade, initials of all words but the legal form) in folded letters; None for what names no firm."""
    if not value:
        return None
    text = re.sub(r"\b((?:[a-z]\.\s?){2,})", lambda m: m.group().replace(".", "").replace(" ", "") + " ", fold(plain(value)) + " ")
    words = [w for w in re.split(r"[^a-z0-9.]+", text) if w.strip(".")]
    words = [w.strip(".") for w in words if w.strip(".") not in ("and", "und", "et", "y", "e", "i")]
    if not words or all(w in NOBODY for w in words):
        return None
    # "S. A." leaves single letters at either end.
    while len(words) > 2 and len(words[-1]) == 1 and len(words[-2]) == 1:
        words = words[:-2]
    own = [w for w in words if w not in LEGAL] or words
    trade = next((_TRADE[w] for w in reversed(own) if w in _TRADE and len(own) > 1), "")
    core = [w for w in own if _TRADE.get(w) != trade or not trade]
    if not core:
        core = own
    # The trade's initial comes last, wherever the trade stands.
    return "".join(core), trade, "".join(w[0] for w in core) + ("".join(w[0] for w in own if w not in core)[:1])


@lru_cache(200_000)
def edits(a: str, b: str) -> int:
    """Edits with swaps of neighbours (restricted Damerau-Levenshtein)."""
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
    return row[-1]


def _formal(name: str) -> frozenset[str]:
    return _FORMAL.get(name, frozenset()) | {name}


def same_given(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0] or any(f[0] == min(a, b, key=len) for f in _formal(max(a, b, key=len)))
    if _formal(a) & _formal(b):
        return True
    return any(edits(x, y) <= (1 if min(len(x), len(y)) < 8 else 2) for x in _formal(a) for y in _formal(b) if min(len(x), len(y)) >= 4)


def same_person(a: tuple[str, str, str], b: tuple[str, str, str], slack: int = 0) -> bool:
    """One person: surnames within an edit (two from twelve letters on), given names that agree, middle initials that don't contradict."""
    if edits(a[0], b[0]) > slack + (1 if min(len(a[0]), len(b[0])) < 12 else 2) or not same_given(a[1], b[1]):
        return False
    return not a[2] or not b[2] or a[2][0] == b[2][0]


def same_firm(a: tuple[str, str, str], b: tuple[str, str, str], slack: int = 0) -> bool:
    """One firm: equal trades, own words within an edit (two from twelve letters on)."""
    limit = 0 if min(len(a[0]), len(b[0])) < 5 else 1 if min(len(a[0]), len(b[0])) < 12 else 2
    if a[1] == b[1]:
        return edits(a[0], b[0]) <= limit + slack
    # A misspelt trade word stands among the own words.
    return (not a[1] or not b[1]) and len(whole(a)) > 8 and edits(whole(a), whole(b)) <= 2


def whole(x: tuple[str, str, str]) -> str:
    """All own words of a firm, the trade word with them."""
    return x[0] + x[1]


KINDS = {"person": (person, same_person), "company": (firm, same_firm)}
#: Roles of the strings that stand for a value: its own words, all its words with the trade, and initials.
CORE, WHOLE, SIGN = 0, 1, 2


def points(values: DataFrame) -> DataFrame:
    """(kind, batch_id, value, a, b, c, keys) of distinct values (kind, batch_id, value); a, b, c are what person or firm gives, keys are structs (role, key, edits).

    A value stands in the metric space by several strings: a person by the surname, a firm by its own words, by these with the trade, and
    by its initials if it has three or more or is itself a lone group of capitals. edits is the radius of a string. Values that name nobody are left out.
    """

    def keys(kind: str, p: tuple[str, str, str]) -> list[tuple[int, str, int]]:
        limit = lambda w: 1 if len(w) < 12 else 2
        if kind == "person":
            return [(CORE, p[0], limit(p[0]))]
        out = [(CORE, p[0], 0 if len(p[0]) < 5 else limit(p[0]))]
        if len(whole(p)) > 6:
            out.append((WHOLE, whole(p), 2))
        if 2 <= len(p[0]) <= 5 and not p[1]:
            out.append((SIGN, p[0], 0))
        elif len(p[2]) >= 3:
            out.append((SIGN, p[2], 0))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, v, KINDS[k][0](v)) for k, v in zip(batch["kind"], batch["value"])]
            rows = [(*p, [{"role": r, "key": w, "edits": e} for r, w, e in keys(k, p)]) if p else (None, None, None, None) for k, _, p in found]
            yield pd.concat([batch[["kind", "batch_id", "value"]], pd.DataFrame(rows, columns=["a", "b", "c", "keys"], index=batch.index)], axis=1)

    shape = "kind string, batch_id bigint, value string, a string, b string, c string, keys array<struct<role:int,key:string,edits:int>>"
    return values.mapInPandas(run, shape).where("a is not null")


def _variants(key: Column, edits: Column) -> Column:
    """Hashes of a string with up to `edits` letters taken out: strings within so many edits, swaps of neighbours included, share one."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.when(edits > 0, F.concat(F.array(key), F.filter(drop(key), lambda w: w != ""))).otherwise(F.array(key))
    twice = F.when(edits > 1, F.concat(once, F.flatten(F.transform(F.filter(once, lambda w: F.length(w) > 1), drop)))).otherwise(once)
    return F.array_distinct(F.transform(twice, lambda w: F.xxhash64(w)))


def radius_pairs(keys: DataFrame, group: list[str], per_pivot: int = PER_PIVOT, dense: int = DENSE) -> DataFrame:
    """(group..., left_key, right_key) of all distinct keys of a group within their edits of each other, the smaller first, and of each key with itself.

    keys: group columns, key and edits (0, 1 or 2), distinct, not null. The smaller edits of two keys count, a swap of neighbours as one; it costs two in
    the Levenshtein distance, so all pairs are within twice the edits there, and some that need more edits come along for the caller to verify.

    A group's pivots are its smallest keys by a hash, one for each per_pivot keys begun, at most MOST_PIVOTS; a key belongs to the cell of its nearest pivot and
    is replicated, by the triangle inequality, to each whose pivot is at most twice its radius farther. Cells of up to `dense` keys are joined whole; in larger ones, where
    short strings lie too close for pivots to part them, keys meet only by a string they share when letters are taken out, so the work grows with the keys
    and not with their pairs. Neither bound drops a pair.
    """
    keyed = keys.withColumns({"h": F.xxhash64("key"), "len": F.length("key")})
    # The least key by hash of each of 64 parts of a group, so that no row grows with the group.
    parts = keyed.groupBy(*group, F.pmod(F.shiftright("h", 8), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), F.min(F.struct("h", "key")).alias("least"))
    wanted = F.least(F.greatest(F.floor(F.sum("n") / per_pivot), F.lit(1)), F.lit(MOST_PIVOTS)).cast("int")
    groups = parts.groupBy(*group).agg(F.transform(F.slice(F.array_sort(F.collect_list("least")), F.lit(1), wanted), lambda x: x.getField("key")).alias("pivots"), F.sum("n").alias("n"))
    letters = F.aggregate(F.split("key", ""), F.lit(0).cast("bigint"), lambda m, ch: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(ch), F.lit(63)))))
    placed = keyed.join(groups, group).withColumn("at", F.transform("pivots", lambda q: F.struct(F.levenshtein("key", q).alias("d"), q.alias("pivot"))))
    placed = placed.withColumns({"home": F.array_min("at"), "letters": letters})
    near = F.filter("at", lambda x: x.getField("d") <= F.col("home.d") + 4 * F.col("edits"))
    sub = F.when(F.col("n") > dense, _variants(F.col("key"), F.col("edits"))).otherwise(F.array(F.lit(0).cast("bigint")))
    placed = placed.withColumn("sub", sub)
    row = ["key", "edits", "len", "letters"]
    left = placed.select(*group, F.explode("sub").alias("sub"), F.col("home.pivot").alias("pivot"), F.col("home.d").alias("d"), *row)
    right = placed.select(*group, "sub", F.explode(near).alias("x"), *row).select(*group, F.explode("sub").alias("sub"), "x.pivot", "x.d", *row)
    renamed = right.select(*group, "pivot", "sub", *[F.col(c).alias("r_" + c) for c in ("d", *row)])
    reach = 2 * F.least("edits", "r_edits")
    pairs = left.join(renamed, [*group, "pivot", "sub"]).where(
        (F.abs(F.col("len") - F.col("r_len")) <= F.least("edits", "r_edits")) & (F.abs(F.col("d") - F.col("r_d")) <= reach)
        & (F.bit_count(F.col("letters").bitwiseXOR(F.col("r_letters"))) <= reach) & F.levenshtein("key", "r_key", 4).between(F.lit(0), reach)
    )
    return pairs.select(*group, F.least("key", "r_key").alias("left_key"), F.greatest("key", "r_key").alias("right_key")).distinct()


def value_links(rows: DataFrame) -> DataFrame:
    """(kind, batch_id, left_value, right_value) of different values of one batch that mean the same, the smaller first.

    rows: kind (person or company), batch_id, value. Null batches and values, and values that name nobody, have no links; repeated rows count once.
    """
    place = ["kind", "batch_id"]
    values = cut(points(rows.where("batch_id is not null and value is not null").select(*place, "value").distinct()))
    spread = values.select(*place, "value", "a", "b", "c", F.explode("keys").alias("k")).select(*place, "value", "a", "b", "c", "k.role", "k.key", "k.edits")
    pairs = radius_pairs(spread.groupBy(*place, "role", "key").agg(F.max("edits").alias("edits")), [*place, "role"])
    side = lambda name: spread.select(*place, "role", F.col("key").alias(f"{name}_key"), *[F.col(c).alias(f"{name}_{c}") for c in ("value", "a", "b", "c")])
    both = pairs.join(side("left"), [*place, "role", "left_key"]).join(side("right"), [*place, "role", "right_key"]).where("left_value != right_value")
    # What role the pair met by says which of the two it can be: initials stand for a lone group of capitals, the whole for a misspelt trade.
    lone = lambda name: (F.length(f"{name}_a") <= 5) & (F.col(f"{name}_b") == "") & (F.col(f"{name}_a") == F.col(f"{name}_key"))
    met = (F.col("role") == CORE) | ((F.col("role") == WHOLE) & ((F.col("left_b") == "") != (F.col("right_b") == ""))) | ((F.col("role") == SIGN) & (lone("left") != lone("right")))
    both = both.where(met)
    told = [*place, "left_value", "right_value"]
    shape = "kind string, batch_id bigint, left_value string, right_value string"

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lefts, rights = zip(batch["left_a"], batch["left_b"], batch["left_c"]), zip(batch["right_a"], batch["right_b"], batch["right_c"])
            keep = [role == SIGN or KINDS[kind][1](a, b) for kind, a, b, role in zip(batch["kind"], lefts, rights, batch["role"])]
            yield batch.loc[keep, told]

    def verify_wide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [KINDS[kind][1](_parsed(kind, a), _parsed(kind, b), 1) for kind, a, b in zip(batch["kind"], batch["left_value"], batch["right_value"])]
            yield batch.loc[keep, told]

    ordered = lambda df: df.select(*place, F.least("left_value", "right_value").alias("left_value"), F.greatest("left_value", "right_value").alias("right_value"))
    # A pair may meet by several roles.
    links = cut(ordered(both.mapInPandas(verify, shape)).distinct())
    # Two misspellings of one value are an edit more apart than either from the value itself: such a pair needs a common link.
    half = links.select(*place, F.col("left_value").alias("hub"), F.col("right_value").alias("v")).unionByName(links.select(*place, F.col("right_value").alias("hub"), F.col("left_value").alias("v")))
    wide = half.join(half.withColumnRenamed("v", "w"), [*place, "hub"]).where("v < w").select(*place, F.col("v").alias("left_value"), F.col("w").alias("right_value")).distinct()
    wide = wide.join(links, told, "left_anti")
    return links.unionByName(wide.mapInPandas(verify_wide, shape))


@lru_cache(100_000)
def _parsed(kind: str, value: str) -> tuple[str, str, str]:
    return KINDS[kind][0](value)


def variant_links(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """(kind, left_id, right_id) of rows of one batch whose different values mean the same.

    rows: batch_id, id, value, and kind (person or company) where it isn't given for all. Null batches and values, and values that name nobody, have no links; repeated rows count once.
    """
    place = ["kind", "batch_id"]
    rows = rows.withColumn("kind", F.lit(kind)) if kind else rows
    rows = rows.where("batch_id is not null and value is not null")
    links = value_links(rows)
    side = lambda name, key: rows.select(*place, F.col("id").alias(key), F.col("value").alias(f"{name}_value"))
    joined = links.join(side("left", "i"), [*place, "left_value"]).join(side("right", "j"), [*place, "right_value"])
    return joined.select("kind", F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id")).where("left_id < right_id").distinct()
