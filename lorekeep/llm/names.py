"""Variant spellings of names typed by people.

Method: every name and alias is cut into tokens.  A symmetric-delete index on the distinct tokens (a token less any one
letter, from nine letters on less any two) finds the tokens that may be typing errors of each other, nicknames aside,
without comparing all; forms that share a token or such a neighbour are aligned token by token by an optimal assignment
that permits typing errors, initials, abbreviations, nicknames and run-together words.

Whether two names match depends on the two names alone, never on how often their words occur or how large the table
is.  That two words which differ by a letter are two words ("Fort", "Port") is known from a fixed list.

From forms to entities: a form *identifies* an entity if it has two full words, or is the entity's whole name of one
word that is no acronym.  Entities and identifying forms make a graph whose components are the groups.  Forms with a
bare initial identify nothing; such an entity joins the one group that fits it, or none if several do.

Scale: equal forms are one node whatever the number of entities that bear them.  A key that would make more than
``PAIRS`` pairs (a common given name) is refined, not dropped: all tokens of the shorter name have a partner, so two
names that match share a key for each of them, and a hot key is joined only together with a second one, a pair
of keys that is still hot with a third, until the key spells the whole name.  Nothing but row counts
reaches the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.components import connected_components
from lorekeep.runtime import clean, cut, partitions

# Spellings of the six entity types, titles, legal forms and joining words, abbreviations that keep a
# vowel, letters that sound alike, and common English nicknames with the names they stand for.
TYPES = {
    "person": "person people user human",
    "organization": "organization organisation company org institution",
    "place": "place city location country",
    "project": "project repo repository",
    "tool": "tool software library framework",
    "concept": "concept topic idea skill",
}
TITLES = set("mr mrs ms miss dr prof sir".split())
LEGAL = set("inc llc ltd gmbh ab co corp ag plc sa bv oy as".split())
JOINING = set("of the and de von van der".split())
ABBREVIATIONS = {"dept": "department", "labs": "laboratories", "lab": "laboratory", "govt": "government", "intl": "international", "natl": "national", "uni": "university"}
SOUNDS = (("ph", "f"), ("ck", "k"), ("c", "k"), ("q", "k"), ("w", "u"), ("y", "i"), ("z", "s"))
NICKNAMES = {
    "al": "alan albert alexander alfred", "alex": "alexander alexandra", "andy": "andrew", "barb": "barbara",
    "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "benji": "benjamin", "benny": "benjamin", "bert": "albert robert",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert",
    "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christina",
    "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah",
    "dick": "richard", "dolly": "dorothy", "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward",
    "eddie": "edward", "eliza": "elizabeth", "ellie": "eleanor", "fran": "frances", "frank": "francis franklin",
    "fred": "frederick", "freddy": "frederick", "gabe": "gabriel", "greg": "gregory", "greta": "margaret", "hank": "henry",
    "harry": "harold henry", "izzy": "isabella", "jack": "john", "jake": "jacob", "jen": "jennifer",
    "jenny": "jennifer", "jerry": "gerald", "jess": "jessica", "jim": "james", "jimmy": "james", "joe": "joseph",
    "joey": "joseph", "josie": "josephine", "jon": "jonathan", "josh": "joshua", "kate": "katherine", "kathy": "katherine",
    "katie": "katherine", "katya": "katherine", "ken": "kenneth", "kit": "christopher", "larry": "lawrence", "len": "leonard",
    "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise",
    "lucy": "lucia lucille", "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "matt": "matthew",
    "max": "maxwell maximilian", "meg": "margaret", "mick": "michael", "mickey": "michael", "mike": "michael",
    "mitch": "mitchell", "molly": "mary", "nancy": "ann", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward",
    "nick": "nicholas", "nell": "eleanor", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia",
    "peg": "margaret", "peggy": "margaret", "pete": "peter", "phil": "philip", "pip": "philippa", "pippa": "philippa",
    "quinn": "quentin", "ray": "raymond", "rich": "richard", "rick": "richard frederick", "rob": "robert",
    "robbie": "robert", "ron": "ronald", "rosie": "rose", "sally": "sarah", "sam": "samuel samantha", "sammie": "samantha samuel", "sammy": "samuel samantha",
    "sandy": "alexander sandra", "sasha": "alexander", "steph": "stephanie", "steve": "steven stephen",
    "sue": "susan susannah", "susie": "susan susannah", "ted": "theodore edward", "teddy": "theodore edward",
    "terry": "terence theresa", "theo": "theodore", "tim": "timothy", "timmy": "timothy", "tom": "thomas tomas",
    "tommy": "thomas tomas", "toni": "antonia", "tony": "anthony", "tori": "victoria", "tricia": "patricia",
    "trish": "patricia", "vic": "victor victoria", "vicky": "victoria", "walt": "walter", "will": "william",
    "zach": "zachary",
}

# Words by which organisations, places, projects, tools and ideas are described.
DESCRIPTORS = set(
    "university institute college school academy department faculty laboratory laboratories research science sciences system systems "
    "technology technologies service services industry industries manufacturing association foundation international national "
    "company group partners holdings bank museum hospital library centre center society council office airways airlines press "
    "north south east west upper lower old new mount mountain saint port fort lake river bay hill city town village island street "
    "project journal tracker planner notebook archive dashboard garden atlas tool toolkit client console editor studio framework "
    "engine runtime compiler scheduler server database method theory principle technique routine habit workflow concept".split()
)

_TYPE_OF = {s: t for t, all_ in TYPES.items() for s in all_.split()}
_FULL_OF = {n: frozenset(f.split()) for n, f in NICKNAMES.items()}
# Given names that are no nicknames of others here.
GIVEN = set(
    "aaron adam adrian agnes ahmed alice amir amy ana andre andrea angela anita anna anne anton antonio arthur astrid beatrice bernard "
    "bianca brian bruno camille carl carla carlos carmen caroline cecilia charlotte clara claire claudia diana diego dmitri dora edith "
    "edgar elena elin elisa ella ellen elsa emil emily emma eric erik erika eva evan felix fatima flora gina giulia gloria grace hana "
    "hanna hannah hans hassan heidi helen helena hugo ian ida igor ingrid irene iris ivan jan jana jane janet jean joan johan johanna "
    "jonas jorge jose juan judith julia julian karen karin karl kevin lara lars laura lena leon lina linda lisa luca lucas luis luke "
    "maja manuel marc marco marcus maria marie marina mario marion mark marta martha martin mateo maya mia mila milan mira mona nadia "
    "nina noah nora olga oliver omar oscar otto paul paula pavel pia rachel ralf ravi rene rita roman rosa ruth sara sean sergei "
    "silvia simon sofia sonia stefan sven tara tanya teresa tina tobias ulla uma vera viktor vincent yusuf zoe".split()
)
_DROPPED = TITLES | LEGAL | JOINING
_GIVEN = GIVEN | set(NICKNAMES) | {f for x in _FULL_OF.values() for f in x}
_KNOWN = _GIVEN | DESCRIPTORS

#: Pairs that one key may make before it is refined; keys a name is refined by at most, beyond which all pairs are made;
#: leading letters from which letters are deleted.
PAIRS, DEEPEST, REACH = 256, 5, 10
#: Letters a token needs for one and for two typing errors.
ONE_ERROR, TWO_ERRORS = 4, 9
#: Letters a word needs to be several words written as one.
RUN_TOGETHER = 8


def tokens_of(name: str) -> list[str]:
    """Lower-cased words in order, without accents, titles, legal forms and joining words; CamelCase is split."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    plain = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", plain)
    plain = re.sub(r"[’']s?\b", "", plain)
    words = re.findall(r"[^\W_]+", plain.lower())
    kept = [w for w in words if w not in _DROPPED]
    return kept or words


def is_acronym(name: str) -> bool:
    """One short word in capitals, dots and a leading article aside."""
    return bool(re.fullmatch(r"\s*(?:[Tt]he\s+)?(?:[A-Z]\.?){2,6}\s*", name))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (adjacent swaps count once), at most ``most + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def sound(token: str) -> str:
    """The token with letters that sound alike written alike."""
    for a, b in SOUNDS:
        token = token.replace(a, b)
    return token


def abbreviates(short: str, full: str) -> bool:
    """``short`` (2 to 5 letters) begins like ``full`` and is a prefix of it or leaves letters out in order."""
    if ABBREVIATIONS.get(short) == full:
        return True
    if not 2 <= len(short) <= 5 or len(full) < len(short) + 1 or short[0] != full[0]:
        return False
    if full.startswith(short):
        return True
    rest = iter(full)
    return all(c in rest for c in short) and not set(short[1:]) & set("aeiou")


EQUAL, TYPO, NICK, SHORT, INITIAL, NONE = 100, 90, 89, 80, 50, 0


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> int:
    """How token ``a`` stands for token ``b``.  Two different known words are never a typing error of each other."""
    if a == b:
        return EQUAL
    if len(a) == 1 or len(b) == 1:
        return INITIAL if a[0] == b[0] else NONE
    if b in _FULL_OF.get(a, ()) or a in _FULL_OF.get(b, ()) or _FULL_OF.get(a, frozenset()) & _FULL_OF.get(b, frozenset()):
        return NICK
    least = min(len(a), len(b))
    if least >= ONE_ERROR and not (a in _KNOWN and b in _KNOWN) and not (a + b).isdigit():
        most = 2 if least >= TWO_ERRORS else 1
        e = edits(a, b, most)
        if e > most:  # spelled by ear, with one slip at most
            by_ear = edits(sound(a), sound(b), 1)
            e = max(1, by_ear) if by_ear <= 1 else e
        if e <= most:
            return TYPO - e
    if abbreviates(a, b) or abbreviates(b, a):
        return SHORT
    return NONE


def assign(score: list[list[int]]) -> list[int]:
    """Column of each row in an assignment of greatest total (rows no more than columns), by shortest augmenting paths."""
    n, m = len(score), len(score[0])
    inf = float("inf")
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = -score[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


STRONG, WEAK = 2, 1


def match(a: list[str], b: list[str]) -> int:
    """STRONG if the two forms spell one name, WEAK if they do but for a bare initial, else 0.

    All tokens of the shorter form have a partner; tokens left over are single letters.  At least one token is equal or
    nearly so, one that is neither a given name nor a describing word if others are shortened, and there
    are no more than two typing errors in all.  Names of one word match but for typing errors.
    """
    if len(a) > len(b):
        a, b = b, a
    if a == b:
        return STRONG
    if len(a) == 1 and len(b) == 1:
        return STRONG if likeness(a[0], b[0]) >= TYPO - 2 and not _nick(a[0], b[0]) else 0
    if len(a) == 1:
        full = [w for w in b if len(w) > 1]
        if len(a[0]) < RUN_TOGETHER or len(full) < 2:
            return 0
        return STRONG if min(edits(a[0], o, 1) for o in _run_together(full)) <= 1 else 0
    score = [[likeness(x, y) for y in b] for x in a]
    got = assign(score)
    kinds = [score[i][j] for i, j in enumerate(got)]
    if min(kinds) == NONE:
        return 0
    left = [b[j] for j in range(len(b)) if j not in set(got)]
    if any(len(w) > 1 for w in left):
        return 0
    near = [i for i, k in enumerate(kinds) if k >= TYPO - 2 and len(a[i]) > 1]
    if sum(TYPO - kinds[i] for i in near if kinds[i] < EQUAL and not _nick(a[i], b[got[i]])) > 2:
        return 0
    if not near or (len(near) < len(kinds) and all(a[i] in _KNOWN and b[got[i]] in _KNOWN for i in near)):
        return 0
    full = sum(k >= SHORT for k in kinds)
    return STRONG if full >= 2 else WEAK


def _nick(a: str, b: str) -> bool:
    return a != b and bool(_called(a) & _called(b))


def _called(token: str) -> frozenset[str]:
    """The full given names a token may stand for."""
    return _FULL_OF.get(token, frozenset()) | ({token} & _GIVEN)


def _run_together(words: list[str]) -> set[str]:
    return {"".join(o) for o in (words, words[::-1], [words[-1], *words[:-1]])}


def deletes(token: str) -> set[str]:
    """The token by its sound less up to as many letters as it may hold typing errors.

    Letters are deleted within the first ``REACH``: of two tokens the leading parts that remain are equal whatever follows.
    A token with two letters for one sound is also indexed as it is written, as a typing error may part them.
    """
    most = 0 if len(token) < ONE_ERROR else 1 if len(token) < TWO_ERRORS else 2
    out: set[str] = set()
    plain = token
    for x, y in SOUNDS:
        plain = plain.replace(x, y) if len(x) == 1 else plain
    for t in {sound(token), plain}:
        part = t[:REACH]
        out.add(part)
        for k in range(1, min(most, len(part) - 1) + 1):
            out |= {"".join(c for i, c in enumerate(part) if i not in gone) for gone in combinations(range(len(part)), k)}
    return out


def _forms(entities: DataFrame, ident: str, name: str, aliases: str, kind: str) -> DataFrame:
    """(id, type, form, own, full): each distinct form of each entity; ``form`` is its tokens in order."""
    kinds = F.create_map(*[x for s, t in _TYPE_OF.items() for x in (F.lit(s), F.lit(t))])
    typed = F.coalesce(kinds[clean(F.col(kind))], F.nullif(clean(F.col(kind)), F.lit("")))
    base = entities.select(
        F.col(ident).cast("string").alias("id"), typed.alias("type"), F.col(name).alias("name"),
        F.coalesce(F.col(aliases), F.array().cast("array<string>")).alias("aliases"),
    ).where("id is not null").dropDuplicates(["id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, n, al in zip(pdf.id, pdf.type, pdf.name, pdf.aliases, strict=True):
                seen = set()
                for k, s in enumerate([n, *al]):
                    if not isinstance(s, str):
                        continue
                    toks = tokens_of(s)
                    form = " ".join(toks)
                    if not form or form in seen:
                        continue
                    seen.add(form)
                    words = [w for w in toks if len(w) > 1]
                    joined = len(toks) == 1 and len(form) >= 14 and s.strip() == s.strip().lower()
                    own = k == 0
                    # an alias of one word identifies only if it may be a whole name written as one word
                    full = len(words) >= 2 or joined or (own and len(toks) == 1 and not is_acronym(s))
                    out.append((i, t if isinstance(t, str) else None, form, own, full))
            yield pd.DataFrame(out, columns=["id", "type", "form", "own", "full"]).astype({"own": bool, "full": bool})

    return base.mapInPandas(run, "id string, type string, form string, own boolean, full boolean")


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def near_tokens(words: DataFrame) -> DataFrame:
    """(t, u): tokens (column t, distinct) that are typing errors or nicknames of each other, in either order."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(_hash(k), t) for t in pdf.t for k in [*deletes(t), *("~" + f for f in _called(t))]]
            yield pd.DataFrame(out, columns=["key", "t"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [likeness(x, y) >= TYPO - 2 for x, y in zip(pdf.t, pdf.u, strict=True)]
            yield pdf[pd.Series(ok, dtype=bool, index=pdf.index)]

    n = partitions(words.sparkSession)
    index = words.select("t").repartition(n).mapInPandas(keys, "key long, t string")
    x, y = index.alias("x"), index.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.t") < F.col("y.t"))).select(F.col("x.t").alias("t"), F.col("y.t").alias("u"))
    near = pairs.distinct().repartition(n).mapInPandas(check, "t string, u string")
    return near.select(F.explode(F.array(F.struct("t", "u"), F.struct(F.col("u").alias("t"), F.col("t").alias("u")))).alias("p")).select("p.t", "p.u")


def _shortened(token: str, side: str) -> set[str]:
    """Keys of a token as the short one of a pair of tokens: an initial, or an abbreviation."""
    out = {side + "L" + token[0]} if len(token) == 1 or (len(token) <= 5 and not set(token[1:]) & set("aeiou")) else set()
    if 2 <= len(token) <= 5:
        out.add(side + "P" + token)
    return out | ({side + "E" + ABBREVIATIONS[token]} if token in ABBREVIATIONS else set())


def _written_out(token: str, side: str) -> set[str]:
    """Keys of a token as the full one of such a pair."""
    out = {side + "L" + token[0]} | {side + "P" + token[:k] for k in range(2, min(5, len(token) - 1) + 1)}
    return out | ({side + "E" + token} if token in _EXPANDED else set())


_EXPANDED = set(ABBREVIATIONS.values())


def _refined(tokens: list[str], near: list[set[str]], asks: bool, size: int) -> Iterator[tuple[str, int]]:
    """(key, rest) of a form for each choice of ``size`` of its tokens, one of them by a hot token; rest: full words not chosen."""
    other = [
        (_shortened(t, "<") | _written_out(t, ">")) if asks else (_written_out(t, "<") | _shortened(t, ">")) for t in tokens
    ]
    full = sum(len(t) > 1 for t in tokens)
    for at in combinations(range(len(tokens)), size):
        rest = full - sum(len(tokens[i]) > 1 for i in at)
        seen = set()
        for hot in at:
            for u in near[hot]:
                for more in product(*[near[i] | other[i] for i in at if i != hot]):
                    seen.add("\t".join(sorted([u, *more])))
        for key in seen:
            yield key, rest


def _joined(asks: DataFrame, own: DataFrame, *on: str) -> DataFrame:
    """(a, b), a < b: pairs of forms that share a key."""
    x, y = asks.alias("x"), own.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    pair = x.join(y, [*same, F.col("x.form") < F.col("y.form")])
    return pair.select(F.col("x.form").alias("a"), F.col("y.form").alias("b"))


def candidates(forms: DataFrame, most: int = PAIRS) -> DataFrame:
    """(a, b), a < b, distinct: pairs of forms (column form, distinct) that may spell one name; none that ``match`` takes is missing."""
    spark = forms.sparkSession
    n = partitions(spark)
    toks = F.split("form", " ")
    words = forms.select("form", (F.size(toks) == 1).alias("one"), F.explode(F.array_distinct(toks)).alias("t")).where("length(t) > 1")
    words = cut(words)
    near = cut(near_tokens(words.select("t").distinct()))
    own = words.select("form", "one", F.col("t").alias("u"))
    asks = cut(words.select("form", "one", "t", F.col("t").alias("u")).unionByName(words.join(near, "t").select("form", "one", "t", "u")))
    # a name of one word meets others of one word only
    out = [_joined(asks.where("one"), own.where("one"), "u")]
    own, asks = own.where("not one").drop("one"), asks.where("not one").drop("one")
    heat = asks.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(own.groupBy("u").agg(F.count(F.lit(1)).alias("m")), "u")
    hot = cut(heat.where(F.col("n") * F.col("m") > most).select("u"))
    cool = asks.join(hot, "u", "left_anti")
    out.append(_joined(cool, own, "u"))
    mine = own.join(hot, "u").groupBy("form").agg(F.collect_set("u").alias("own"))
    theirs = asks.join(hot, "u").groupBy("form").agg(F.collect_set(F.struct("t", "u")).alias("asks"))
    todo = cut(theirs.join(mine, "form", "left"))

    def level(size: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for form, exact, asked in zip(pdf.form, pdf.own, pdf.asks, strict=True):
                    tokens = form.split(" ")
                    have = set(exact) if exact is not None else set()
                    reach: dict[str, set[str]] = {}
                    for p in asked:
                        reach.setdefault(p["t"], set()).add(p["u"])
                    for k, rest in set(_refined(tokens, [{t} & have for t in tokens], False, size)):
                        rows.append((_hash(k), form, False, rest))
                    for k, rest in set(_refined(tokens, [reach.get(t, set()) for t in tokens], True, size)):
                        rows.append((_hash(k), form, True, rest))
                yield pd.DataFrame(rows, columns=["key", "form", "asking", "rest"]).astype({"asking": bool, "rest": "int32"})

        return run

    for size in range(2, DEEPEST + 1):
        if todo.isEmpty():
            break
        rows = cut(todo.where(F.size(F.split("form", " ")) >= size).repartition(n).mapInPandas(level(size), "key long, form string, asking boolean, rest int"))
        a, o = rows.where("asking").drop("asking"), rows.where("not asking").drop("asking")
        if size == DEEPEST:
            out.append(_joined(a, o, "key"))
            break
        heat = a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(o.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
        hot = cut(heat.where(F.col("n") * F.col("m") > most).select("key"))
        out.append(_joined(a.join(hot, "key", "left_anti"), o, "key"))
        # of a hot key only the names that it spells whole are joined; the others need one more token
        out.append(_joined(a.join(hot, "key").where("rest = 0"), o.where("rest = 0"), "key"))
        more = rows.join(hot, "key").select("form").distinct()
        todo = cut(todo.join(more, "form", "left_semi"))
    out.append(_run_together_pairs(forms))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.distinct()


def _run_together_pairs(forms: DataFrame) -> DataFrame:
    """(a, b), a < b: forms of one word and forms of several whose words run together within one typing error.

    One error leaves the first or the second half of a word as it was, unless it swaps the two letters in the middle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for form in pdf.form:
                words = [w for w in form.split(" ") if len(w) > 1]
                if " " not in form and len(form) >= RUN_TOGETHER:
                    keys = set()
                    for n in range(len(form) - 1, len(form) + 2):
                        h = n // 2
                        keys |= {f"{n}<{form[:h]}", f"{n}>{form[h - n:]}"}
                    h = len(form) // 2
                    keys.add(f"{len(form)}<{form[: h - 1]}{form[h]}")
                    rows += [(_hash(k), form, True) for k in keys]
                elif " " in form and len(words) >= 2:
                    keys = {k for j in _run_together(words) for n in [len(j)] for k in (f"{n}<{j[: n // 2]}", f"{n}>{j[n // 2:]}")}
                    rows += [(_hash(k), form, False) for k in keys]
            yield pd.DataFrame(rows, columns=["key", "form", "one"]).astype({"one": bool})

    keys = forms.select("form").repartition(partitions(forms.sparkSession)).mapInPandas(run, "key long, form string, one boolean")
    x, y = keys.where("one").alias("x"), keys.where("not one").alias("y")
    return x.join(y, F.col("x.key") == F.col("y.key")).select(F.least("x.form", "y.form").alias("a"), F.greatest("x.form", "y.form").alias("b"))


def form_links(forms: DataFrame, most: int = PAIRS) -> DataFrame:
    """(a, b, strength): pairs of different forms (column form, distinct) that spell one name, a < b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [match(x.split(" "), y.split(" ")) for x, y in zip(pdf.a, pdf.b, strict=True)]
            yield pdf.assign(strength=pd.Series(s, dtype="int32", index=pdf.index))[lambda p: p.strength > 0]

    pairs = candidates(forms, most).repartition(partitions(forms.sparkSession))
    return pairs.mapInPandas(run, "a string, b string, strength int")


def name_groups(
    entities: DataFrame, ident: str = "id", name: str = "name", aliases: str = "aliases", kind: str = "type"
) -> DataFrame:
    """(id, group_id, type): the group of every entity that shares its real entity with another one.

    Types must not contradict each other; a null or blank type fits any, but a form seen without type joins typed
    ones only if these are of one type.  Null and blank names and aliases count for nothing; ids repeated count once.
    """
    forms = cut(_forms(entities, ident, name, aliases, kind))
    full = forms.where("full")
    nodes = cut(full.select("form", "type").distinct())
    links = cut(form_links(forms.select("form").distinct()))
    label = lambda f, t: F.concat_ws("\u0001", F.lit("f"), f, F.coalesce(t, F.lit("")))
    # strong links, and each form with itself, between the types it is seen with
    strong = links.where(f"strength = {STRONG}").select("a", "b")
    x, y = nodes.alias("x"), nodes.alias("y")
    across = strong.join(x, F.col("a") == F.col("x.form")).join(y, F.col("b") == F.col("y.form")).select(
        F.col("x.form").alias("fa"), F.col("x.type").alias("ta"), F.col("y.form").alias("fb"), F.col("y.type").alias("tb")
    )
    within = (
        nodes.where("type is null").alias("x").join(nodes.where("type is not null").alias("y"), "form")
        .select(F.col("form").alias("fa"), F.col("x.type").alias("ta"), F.col("form").alias("fb"), F.col("y.type").alias("tb"))
    )
    edges = cut(across.unionByName(within).where("ta <=> tb or ta is null or tb is null"))
    loose = edges.where("ta is null and tb is not null").select(F.col("fa").alias("f"), F.col("tb").alias("t")).unionByName(
        edges.where("tb is null and ta is not null").select(F.col("fb").alias("f"), F.col("ta").alias("t"))
    )
    clash = loose.groupBy("f").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 <> t1").select("f")
    open_ = edges.where("ta <=> tb")
    typed = edges.where("not (ta <=> tb)").withColumn("f", F.when(F.col("ta").isNull(), F.col("fa")).otherwise(F.col("fb")))
    edges = open_.unionByName(typed.join(clash, "f", "left_anti").drop("f"))
    own = full.select(F.concat(F.lit("e\u0001"), F.col("id")).alias("u"), label(F.col("form"), F.col("type")).alias("v"))
    graph = own.unionByName(edges.select(label(F.col("fa"), F.col("ta")).alias("u"), label(F.col("fb"), F.col("tb")).alias("v")))
    groups = cut(connected_components(graph, "u", "v"))
    # entities known by a bare initial only: the one group that fits
    ent = groups.where(F.col("id").startswith("e\u0001")).select(F.substring("id", 3, 1_000_000).alias("id"), "group_id")
    ftype = groups.where(F.col("id").startswith("f\u0001")).select(
        F.split("id", "\u0001")[1].alias("form"), F.nullif(F.split("id", "\u0001")[2], F.lit("")).alias("gt"), "group_id"
    )
    bare = forms.join(ent.select("id"), "id", "left_anti").where("own")
    weak = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    fit = (
        bare.join(weak, F.col("form") == F.col("a")).select("id", "type", F.col("b").alias("form"))
        .join(ftype, "form").where("type is null or gt is null or type = gt")
        # forms seen without type do not compete with typed ones
        .groupBy("id").agg(*[f(F.when(c, F.col("group_id"))).alias(n) for f, n, c in (
            (F.min, "g0", F.col("gt").isNotNull()), (F.max, "g1", F.col("gt").isNotNull()), (F.min, "u0", F.col("gt").isNull()), (F.max, "u1", F.col("gt").isNull()),
        )])
        .where("coalesce(g0, u0) = coalesce(g1, u1)").select("id", F.coalesce("g0", "u0").alias("group_id"))
    )
    kinds = forms.select("id", "type").distinct()
    return ent.unionByName(fit).join(kinds, "id").select("id", "group_id", "type")


def variant_pairs(entities: DataFrame, **columns: str) -> DataFrame:
    """(id_a, id_b), a < b: all pairs of entities of one group whose types do not contradict each other."""
    g = cut(name_groups(entities, **columns))
    a, b = g.alias("a"), g.alias("b")
    fits = F.col("a.type").isNull() | F.col("b.type").isNull() | (F.col("a.type") == F.col("b.type"))
    return a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.id") < F.col("b.id")) & fits).select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")
    )
