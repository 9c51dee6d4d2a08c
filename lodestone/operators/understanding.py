"""Query understanding over a table of queries: spelling, abbreviations, synonyms, intents, entities, variants.

The knowledge is a small dimension (it is written by hand), so it travels with the
plan: maps and patterns as literals, sequential matching in Arrow-batched functions.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from lodestone.functions.text import collapse, strip
from lodestone.operators.lineage import cut

MAX_VARIANTS, FUZZY, FUZZY_TERMS = 4, 0.86, 0.82
# Questions made of short queries, and words that begin a question already.
QUESTIONS = ("How do I use {}?", "What is {}?")
QUESTION_WORDS = r"\s*(how|what|where|when|why|who|can|do|is)\b"


@dataclass(frozen=True)
class Group:
    id: str
    canonical: str
    kind: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Intent:
    name: str
    patterns: tuple[str, ...]
    phrasings: tuple[str, ...] = ()
    boost: tuple[str, ...] = ()
    procedural: bool = False


@dataclass(frozen=True)
class Knowledge:
    groups: tuple[Group, ...] = ()
    intents: tuple[Intent, ...] = ()
    abbreviations: dict[str, str] = field(default_factory=dict)
    acronyms: dict[str, str] = field(default_factory=dict)
    spelling: dict[str, str] = field(default_factory=dict)

    def owners(self) -> dict[str, Group]:
        """The first group that lists each lower-cased term."""
        out: dict[str, Group] = {}
        for g in self.groups:
            for t in g.terms:
                out.setdefault(t.lower(), g)
        return out

    def synonyms(self) -> dict[str, list[str]]:
        """All other terms of every group that lists a term, sorted."""
        out: dict[str, set[str]] = {}
        for g in self.groups:
            for t in g.terms:
                out.setdefault(t.lower(), set()).update(o for o in g.terms if o.lower() != t.lower())
        return {t: sorted(o) for t, o in out.items()}

    def phrases(self) -> list[tuple[str, ...]]:
        """Terms of several words (a hyphen parts words), longest first."""
        split = {tuple(t.lower().replace("-", " ").split()) for g in self.groups for t in g.terms}
        return sorted((p for p in split if len(p) > 1), key=lambda p: (-len(p), p))


def overlay(base: Knowledge, extra: dict) -> Knowledge:
    """base with a file's entries: groups and intents replaced by id, maps merged by lower-cased key; a bad pattern is left out."""
    groups = {g.id: g for g in base.groups}
    for key, g in (extra.get("synonyms") or {}).items():
        groups[key] = Group(key, g.get("canonical", key), g.get("kind", "object"), tuple(map(str, g.get("terms") or ())))
    intents = {i.name: i for i in base.intents}
    for key, i in (extra.get("intents") or {}).items():
        good = []
        for p in i.get("patterns") or ():
            try:
                re.compile(p)
                good.append(p)
            except re.error:
                continue
        intents[key] = Intent(key, tuple(good), tuple(i.get("phrasings") or ()), tuple(i.get("boost") or ()), bool(i.get("procedural")))
    merged = lambda mine, name: mine | {str(k).lower(): str(v) for k, v in (extra.get(name) or {}).items()}
    return Knowledge(tuple(groups.values()), tuple(intents.values()), merged(base.abbreviations, "abbreviations"), merged(base.acronyms, "acronyms"), merged(base.spelling, "spell_corrections"))


def load_knowledge(path: str | None, base: Knowledge = Knowledge()) -> Knowledge:
    """base overlaid with a YAML file; base alone if the file can't be read."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return overlay(base, yaml.safe_load(f) or {})
    except (ImportError, OSError, TypeError, AttributeError, ValueError):
        return base


def vocabulary_match(words: Iterable[str], vocabulary: list[str], cutoff: float) -> dict[str, str]:
    """Closest vocabulary word of each word, where one is close enough."""
    found = {w: difflib.get_close_matches(w, vocabulary, n=1, cutoff=cutoff) for w in words}
    return {w: m[0] for w, m in found.items() if m}


_NORMAL = StructType([StructField("normalized", StringType()), StructField("corrections", MapType(StringType(), StringType()))])


def rewrite_query(corrections: dict[str, str], vocabulary: list[str], lexicon: set[str], upper: tuple[str, ...] = (), cutoff: float = FUZZY):
    """A column function: a query with its tokens corrected by a curated map, else by the closest vocabulary word; tokens that the lexicon knows stay.

    upper: vocabulary words that are written in capitals.  A query of which nothing changes stays as it is.
    """

    @F.pandas_udf(StringType())
    def run(query: pd.Series) -> pd.Series:
        memo: dict[str, str | None] = {}

        def better(word: str) -> str | None:
            if word in corrections:
                return corrections[word]
            if len(word) < 3 or word in lexicon or not vocabulary:
                return None
            ratios = [difflib.SequenceMatcher(None, word, v).ratio() for v in vocabulary]
            best = max(range(len(ratios)), key=ratios.__getitem__)
            return (vocabulary[best].upper() if vocabulary[best] in upper else vocabulary[best]) if ratios[best] >= cutoff else None

        def one(q: str | None) -> str | None:
            if not q or not q.strip():
                return q
            out, changed = [], False
            for token in q.split():
                bare = re.sub(r"[^a-z0-9]", "", token, flags=re.I).lower()
                if bare not in memo:
                    memo[bare] = better(bare) if len(bare) >= 3 else None
                changed |= memo[bare] is not None
                out.append(memo[bare] or token)
            return " ".join(out) if changed else q

        return query.map(one)

    return run


def normalize(knowledge: Knowledge, vocabulary: list[str] | None = None, cutoff: float = FUZZY):
    """A column function: query -> (normalized, corrections). The first map that knows a token decides; then the vocabulary."""
    known = set(vocabulary or ())

    @F.pandas_udf(_NORMAL)
    def run(query: pd.Series) -> pd.DataFrame:
        split = [re.sub(r"[^\w\s'\-]+", " ", q or "").split() for q in query]
        keys = {t.lower().strip("'-") for tokens in split for t in tokens}
        odd = [k for k in keys if len(k) >= 4 and k not in known and not (k in knowledge.spelling or k in knowledge.acronyms or k in knowledge.abbreviations)]
        close = vocabulary_match(odd, vocabulary, cutoff) if vocabulary is not None else {}
        rows = []
        for tokens in split:
            out, fixed = [], {}
            for token in tokens:
                key = token.lower().strip("'-")
                if not key:
                    continue
                if key in knowledge.spelling:
                    new = knowledge.spelling[key]
                    if new.lower() != key:
                        fixed[token] = new
                elif key in knowledge.acronyms:
                    new = knowledge.acronyms[key]
                elif key in knowledge.abbreviations or key in close:
                    new = fixed[token] = knowledge.abbreviations.get(key) or close[key]
                else:
                    new = key
                out.append(new)
            rows.append((" ".join(out), fixed))
        return pd.DataFrame(rows, columns=["normalized", "corrections"])

    return run


_MATCH = ArrayType(StructType([StructField("term", StringType()), StructField("group_id", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType())]))


class Terms:
    """The knowledge's terms as a tree of tokens, built once a task: a text is read once, whatever their number."""

    def __init__(self, knowledge: Knowledge):
        self.owner = {t: g.id for t, g in knowledge.owners().items()}
        self.tree: dict = {}
        for rank, phrase in enumerate(knowledge.phrases()):
            if " ".join(phrase) in self.owner:
                node = self.tree
                for token in phrase:
                    node = node.setdefault(token, {})
                node[None] = rank  # no token is None

    def occurrences(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(rank of the phrase, start, length) of every place where a phrase stands."""
        out = []
        for start in range(len(tokens)):
            node = self.tree
            for end in range(start, len(tokens)):
                node = node.get(tokens[end])
                if node is None:
                    break
                if None in node:
                    out.append((node[None], start, end - start + 1))
        return out

    def found(self, text: str) -> list[tuple[str, str, int, int]]:
        """(term, group, start, length) in reading order; phrases take their tokens first, longest first."""
        tokens = text.lower().split()
        free, chosen = bytearray(b"\1" * len(tokens)), []
        for _, start, n in sorted(self.occurrences(tokens)):
            if all(free[start : start + n]):
                free[start : start + n] = bytes(n)
                chosen.append((start, n))
        chosen += [(i, 1) for i, t in enumerate(tokens) if free[i] and t in self.owner]
        terms = ((" ".join(tokens[i : i + n]), i, n) for i, n in sorted(chosen))
        return [(t, self.owner[t], i, n) for t, i, n in terms]


def match_terms(knowledge: Knowledge):
    @F.pandas_udf(_MATCH)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(knowledge)
        for text in texts:
            yield text.map(lambda t: terms.found(t or ""))

    return run


def ordered_terms(matches: Column) -> Column:
    """Distinct matched terms: phrases (longest first), then single words."""
    keyed = F.array_sort(F.transform(matches, lambda m: F.struct((-m["length"]).alias("n"), F.when(m["length"] > 1, m["term"]).otherwise("").alias("t"), m["start"].alias("s"), m["term"].alias("term"))))
    return F.array_distinct(F.transform(keyed, lambda m: m["term"]))


def expansions(knowledge: Knowledge, matches: Column) -> Column:
    """Array of (term, synonyms) of the matched terms."""
    known = knowledge.synonyms()
    table = F.create_map(*[x for t, s in known.items() for x in (F.lit(t), F.array(*map(F.lit, s)) if s else F.expr("cast(array() as array<string>)"))]) if known else F.expr("cast(map() as map<string,array<string>>)")
    return F.transform(ordered_terms(matches), lambda t: F.struct(t.alias("term"), F.try_element_at(table, t).alias("synonyms")))


def expanded(normalized: Column, added: Column) -> Column:
    """The query with every synonym once (case ignored) that it does not hold as a token."""
    every = F.flatten(F.transform(added, lambda e: e["synonyms"]))
    state = F.struct(F.split(F.lower(normalized), r"\s+").alias("seen"), F.expr("cast(array() as array<string>)").alias("new"))
    new = F.aggregate(
        every, state,
        lambda acc, s: F.when(F.array_contains(acc["seen"], F.lower(s)), acc).otherwise(F.struct(F.concat(acc["seen"], F.array(F.lower(s))).alias("seen"), F.concat(acc["new"], F.array(s)).alias("new"))),
        lambda acc: acc["new"],
    )
    return F.when(F.size(new) > 0, F.concat_ws(" ", normalized, F.array_join(new, " "))).otherwise(normalized)


def intents(knowledge: Knowledge, normalized: Column) -> Column:
    """Names of all intents with a pattern that occurs, in declared order."""
    hits = [F.when(F.greatest(F.lit(False), F.lit(False), *[normalized.rlike(f"(?i){p}") for p in i.patterns]), F.lit(i.name)) for i in knowledge.intents if i.patterns]
    return F.array_compact(F.array(*hits)) if hits else F.expr("cast(array() as array<string>)")


def entities(knowledge: Knowledge, matches: Column) -> Column:
    """Distinct canonical names of the systems named, in reading order."""
    systems = {g.id: g.canonical for g in knowledge.groups if g.kind == "system"}
    if not systems:
        return F.expr("cast(array() as array<string>)")
    table = F.create_map(*[F.lit(x) for pair in systems.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(matches, lambda m: F.try_element_at(table, m["group_id"]))))


def _substitutions(knowledge: Knowledge) -> Column:
    """Map from a term to (pattern, replacement) of its canonical form and its longest synonym, where they differ from it and each other."""
    owners, entries = knowledge.owners(), []
    quoted = lambda t: r"(?iU)\b\Q" + t.replace("\\E", r"\E\\E\Q") + r"\E\b"
    for term, synonyms in knowledge.synonyms().items():
        others = {owners[term].terms[0]: 0, max(synonyms, key=len): 1} if synonyms else {}
        pairs = [F.struct(F.lit(quoted(term)).alias("pattern"), F.lit(re.sub(r"([\\$])", r"\\\1", o)).alias("new")) for o in others if o.lower() != term]
        if pairs:
            entries += [F.lit(term), F.array(*pairs)]
    return F.create_map(*entries) if entries else F.expr("cast(map() as map<string, array<struct<pattern: string, new: string>>>)")


def variants(knowledge: Knowledge, normalized: Column, found: Column, added: Column, most: int = MAX_VARIANTS) -> Column:
    """The query, its intents' phrasings, substitutions of its terms, and questions for short ones: the first most + 1, each once (case ignored)."""
    none, texts = F.expr("cast(array() as array<string>)"), lambda *t: F.array(*map(F.lit, t))
    phrasings = [F.when(F.array_contains(found, i.name), texts(*i.phrasings)).otherwise(none) for i in knowledge.intents if i.phrasings]
    changed = F.flatten(F.transform(added, lambda e: F.transform(F.coalesce(F.try_element_at(_substitutions(knowledge), e["term"]), F.expr("cast(array() as array<struct<pattern: string, new: string>>)")), lambda c: F.regexp_replace(normalized, c["pattern"], c["new"]))))
    short = (F.size(F.split(collapse(normalized), " ")) <= 3) & ~normalized.rlike(rf"(?iU)^{QUESTION_WORDS}")
    questions = F.when(short, F.array(*[F.concat(F.lit(before), normalized, F.lit(after)) for before, after in (q.split("{}") for q in QUESTIONS)])).otherwise(none)
    listed = F.filter(F.transform(F.concat(F.array(normalized), *phrasings, changed, questions), strip), lambda c: c != "")
    # a lambda's variable is computed once
    once = F.get(F.transform(F.array(listed), lambda a: F.filter(a, lambda c, i: F.array_position(F.transform(a, F.lower), F.lower(c)) == i + 1)), F.lit(0))
    return F.when(normalized == "", none).otherwise(F.slice(once, 1, most + 1))


def process(queries: DataFrame, knowledge: Knowledge, vocabulary: list[str] | None = None, most: int = MAX_VARIANTS, stages: frozenset[str] = frozenset(("normalize", "synonyms", "intents", "variants"))) -> DataFrame:
    """queries (query_id, query) with normalized, corrections, lexical, matches, intents, entities, boost_terms, procedural, variants, understood, changed.

    stages: those that run; without normalize the query is taken as it is, without synonyms nothing is expanded, without intents
    none is found, and without variants the query is its only one.
    """
    if "intents" not in stages:
        knowledge = replace(knowledge, intents=())
    if "synonyms" not in stages:
        knowledge = replace(knowledge, groups=())
    most = most if "variants" in stages else 0

    if "normalize" in stages:
        base = queries.withColumn("_n", normalize(knowledge, vocabulary)("query")).select("*", "_n.*").drop("_n")
    else:
        base = queries.withColumns({"normalized": F.coalesce("query", F.lit("")), "corrections": F.create_map().cast("map<string,string>")})
    base = base.withColumn("matches", match_terms(knowledge)("normalized"))
    base = base.withColumns({"expansions": expansions(knowledge, F.col("matches")), "intents": intents(knowledge, F.col("normalized")), "entities": entities(knowledge, F.col("matches"))})
    boost = {i.name: sorted({b.lower() for b in i.boost}) for i in knowledge.intents}
    chosen = [F.when(F.array_contains("intents", name), F.array(*map(F.lit, b))).otherwise(F.expr("cast(array() as array<string>)")) for name, b in boost.items() if b]
    steps = [i.name for i in knowledge.intents if i.procedural]
    return base.select(
        *queries.columns, "normalized", "corrections", expanded(F.col("normalized"), F.col("expansions")).alias("lexical"), "matches", "intents", "entities",
        (F.array_sort(F.array_distinct(F.concat(*chosen))) if chosen else F.expr("cast(array() as array<string>)")).alias("boost_terms"),
        (F.arrays_overlap("intents", F.array(*map(F.lit, steps))) if steps else F.lit(False)).alias("procedural"),
        variants(knowledge, F.col("normalized"), F.col("intents"), F.col("expansions"), most).alias("variants"),
        ((F.size("intents") > 0) | (F.size("entities") > 0)).alias("understood"), ((F.size(F.map_keys("corrections")) > 0) | (F.size("expansions") > 0)).alias("changed"),
    )


def _lengths(words: DataFrame, column: str) -> list[int]:
    """The distinct lengths of the words: no more than the longest has letters."""
    return sorted(r.n for r in words.select(F.char_length(column).alias("n")).distinct().collect())


def _bands(own: str, other: str, lengths: list[int], cutoff: float) -> Column:
    """For a word of `own` letters: the lengths of partners that it can be close to, and how many letters both may lack together."""
    known = f"array({', '.join(map(str, lengths))})" if lengths else "cast(array() as array<int>)"
    # ratio = 2 m / (a + b) for m matching letters, of which there are min(a, b) at most
    lacking = f"{own} + {other} - 2 * cast(ceil({cutoff}D / 2 * ({own} + {other}) - 1e-9D) as int)"
    return F.expr(f"inline(filter(transform({known}, {other} -> struct({other}, {lacking} as lacking)), x -> x.lacking >= abs({own} - x.{other})))")


def close_pairs(terms: DataFrame, words: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (term, word) among which are all whose ratio of matching letters reaches the cutoff; terms (term) and words (word) are distinct.

    A word of a letters and a term of b that match in m of them lack a + b - 2 m, which the cutoff bounds.  Of that many
    and one more parts of the word at least one is whole in the term, and moved by no more than the letters lacking before
    and after it allow.  So words are keyed by lengths, part and the part's letters, and terms by the substrings that may be
    that part: nothing is lost, and only words that share a part at its place meet.
    """
    part = ["cast(i * a div (lacking + 1) as int) as start", "cast((i + 1) * a div (lacking + 1) - i * a div (lacking + 1) as int) as size"]
    listed = words.selectExpr("word", "char_length(word) as a").select("word", "a", _bands("a", "b", _lengths(terms, "term"), cutoff))
    keyed = listed.selectExpr("word", "a", "b", "lacking", "explode(sequence(0, lacking)) as i").selectExpr("*", *part).selectExpr("word", "a", "b", "i", "lacking", "substring(word, start + 1, size) as letters")
    probes = terms.selectExpr("term", "char_length(term) as b").select("term", "b", _bands("b", "a", _lengths(words, "word"), cutoff))
    probes = probes.selectExpr("*", "explode(sequence(0, lacking)) as i").selectExpr("term", "a", "b", "i", "lacking", *part)
    moved = probes.selectExpr("*", "explode(sequence(greatest(0, start - cast((lacking - b + a) div 2 as int)), start + cast((lacking + b - a) div 2 as int))) as at").filter("at + size <= b")
    met = moved.selectExpr("term", "a", "b", "i", "substring(term, at + 1, size) as letters").distinct().join(keyed, ["a", "b", "i", "letters"])
    # a letter that one of them does not have at all lacks too
    alone = "size(array_except(split({0}, ''), split({1}, '')))"
    return met.filter(f"{alone.format('term', 'word')} + {alone.format('word', 'term')} <= lacking").select("term", "word").distinct()


def closest_terms(terms: DataFrame, vocabulary: DataFrame, cutoff: float = FUZZY_TERMS) -> DataFrame:
    """terms (query_id, term) and, beside those of four letters or more that the vocabulary (term) lacks, the closest word it has, if one is close enough.

    The pairs of `close_pairs` are verified in Arrow batches; of equally close words the last in order is taken.
    """
    vocabulary = cut(vocabulary.select("term").distinct())
    odd = cut(terms.select("term").distinct().filter(F.length("term") >= 4).join(vocabulary, "term", "left_anti"))
    pairs = close_pairs(odd, vocabulary.select(F.col("term").alias("word")), cutoff)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, last = difflib.SequenceMatcher(None), None
        for part in batches:
            ratios = []
            for term, word in zip(part.column("term").to_pylist(), part.column("word").to_pylist(), strict=True):
                if term != last:  # what the matcher knows of a term serves all its words
                    matcher.set_seq2(term)
                    last = term
                matcher.set_seq1(word)
                ratios.append(matcher.ratio() if matcher.quick_ratio() >= cutoff else 0.0)
            yield pa.RecordBatch.from_arrays([part.column("term"), pa.array(ratios, pa.float64()), part.column("word")], ["term", "ratio", "word"])

    ratios = pairs.mapInArrow(verified, "term string, ratio double, word string").filter(F.col("ratio") >= cutoff)
    best = ratios.groupBy("term").agg(F.max(F.struct("ratio", "word")).alias("m"))
    return terms.unionByName(terms.join(best, "term").select("query_id", F.col("m.word").alias("term")))
