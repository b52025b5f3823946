"""Rule tables for relations, intents and query hints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, content_tokens, nvl

# Patterns of relations, in order of precedence.
RELATIONS = (
    ("causes", r"\b(?:causes?|caused|leads? to|results? in|вызывает?|приводит к|стал[аои]? причиной)\b"),
    ("prevents", r"\b(?:prevents?|blocks?|мешает|предотвращает|блокирует)\b"),
    ("depends_on", r"\b(?:depends? on|requires?|зависит от|требует)\b"),
    ("part_of", r"\b(?:part of|belongs? to|часть|входит в)\b"),
    ("located_in", r"\b(?:located in|based in|находится в|расположен[ао]? в)\b"),
    ("associated_with", r"\b(?:associated with|related to|связан[ао]? с|относится к)\b"),
)

# Relation names that are kept, and what other names stand for.
ONTOLOGY = (
    "acquired_by", "associated_with", "causes", "compares_to", "competes_with", "contributes_to", "depends_on", "featured_in", "hosts",
    "impacted_by", "indirectly_causes", "located_in", "member_of", "part_of", "plays_for", "prevents", "produces", "reports_on", "uses", "works_for",
)
ALIASES = {
    "competes_against": "competes_with",
    "related_to": "associated_with",
    "played_against": "competes_with",
    "has_player": "plays_for",
    "scores": "contributes_to",
}

# Parts of words that show what a query is after.
INTENTS = (
    ("causal", ("why", "cause", "reason", "почему", "причин")),
    ("factual", ("where", "location", "где", "мест")),
    ("global", ("overview", "theme", "summar", "обзор", "тем", "итог")),
)

# Query words and the hint that each of them gives.
HINTS = (
    (("spouse", "wife", "husband", "married",), "spouse partner wife husband"),
    (("partner",), "partner spouse collaborator"),
    (("founded", "founder", "co-founded", "cofounder",), "founder founded co-founder"),
    (("headquartered", "headquarters", "headquarter",), "headquarters headquartered location"),
    (("employer", "employed", "worked",), "employer employed by organization"),
    (("child", "children", "son", "daughter",), "child son daughter"),
    (("mother", "father", "parent", "grandmother", "grandfather",), "parent mother father grandmother grandfather"),
    (("owner", "owned", "owns",), "owner owned by owns"),
    (("manufacturer", "manufactured", "maker",), "manufacturer maker produced by"),
    (("distributed", "distributor",), "distributed distributor"),
    (("located", "location", "province", "city", "country",), "located location city country province"),
    (("border", "borders",), "border shares border"),
    (("member", "members",), "member of organization group"),
    (("succeeded", "successor", "preceded",), "succeeded successor preceded"),
    (("performer", "performed", "artist", "singer", "actor",), "performer artist singer actor"),
)
GENERIC = (
    "what", "which", "whose", "where", "when", "who", "whom", "name", "called", "green", "person", "people", "entity", "object", "thing",
)

# Fixed values: (query words, ((parts of the entity's type, factor), ...)), tried in order.
BRIDGE_PEOPLE = (
    "spouse", "wife", "husband", "partner", "performer", "artist", "singer", "actor",
)
BRIDGE_FIRMS = (
    "headquartered", "headquarters", "employer", "company", "organization",
)
BRIDGE_PLACES = (
    "where", "located", "location", "city", "country", "province",
)


def relation_of(sentence: Column) -> Column:
    """struct<name, kind>: the first relation whose pattern is in the sentence, else (co_occurs, implicit)."""
    out = None
    for name, pattern in RELATIONS:
        hit = nvl(sentence).rlike(f"(?iu){pattern}")
        value = F.struct(F.lit(name).alias("name"), F.lit("explicit").alias("kind"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("co_occurs").alias("name"), F.lit("implicit").alias("kind")))


def normalize_relation(value: Column) -> Column:
    """struct<relation, ontology_ok>: the name in the ontology, or associated_with and false."""
    plain = F.regexp_replace(F.regexp_replace(casefold(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    name = F.coalesce(F.try_element_at(known, plain), plain)
    ok = name.isin(*ONTOLOGY)
    return F.struct(F.when(ok, name).otherwise("associated_with").alias("relation"), ok.alias("ontology_ok"))


def useful_for(relation: Column) -> Column:
    """What a relation can help to answer."""
    tags = lambda *t: F.array(*map(F.lit, t))
    return (
        F.when(relation.isin("causes", "prevents", "depends_on"), tags("causal", "diagnostic"))
        .when(relation.isin("located_in", "part_of"), tags("factual", "structural"))
        .otherwise(tags("factual", "exploratory"))
    )


def intent(query: Column) -> Column:
    folded, out = casefold(query), None
    for name, parts in INTENTS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | folded.contains(p)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("exploratory"))


def relation_hints(query: Column) -> Column:
    """At most four phrases: those whose words are in the query, then its first five specific words."""
    own = content_tokens(query)
    phrases = [F.when(F.arrays_overlap(own, F.array(*map(F.lit, w))), F.lit(p)) for w, p in HINTS]
    rest = F.array_join(F.slice(F.filter(own, lambda t: ~t.isin(*GENERIC) & (F.length(t) > 2)), 1, 5), " ")
    every = F.filter(F.array(*phrases, rest), lambda h: h.isNotNull() & (h != ""))
    return F.slice(F.array_distinct(every), 1, 4)


def any_part(text: Column, *parts: str) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | text.contains(p)
    return hit


def bridge_factor(query_tokens: Column, kind: Column, title_size: Column) -> Column:
    """How well an entity (``kind``: its type, category and description, casefolded) suits what the query asks for."""
    asks = lambda words: F.arrays_overlap(query_tokens, F.array(*map(F.lit, words)))
    people, firms, places = asks(BRIDGE_PEOPLE), asks(BRIDGE_FIRMS), asks(BRIDGE_PLACES)
    return (
        F.when(people & any_part(kind, "person", "musician", "artist"), 1.9)
        .when(people & (title_size == 1), 0.45)
        .when(people & any_part(kind, "album", "lake", "location", "date", "city", "country"), 0.55)
        .when(firms & any_part(kind, "organization", "company", "institution", "agency", "business"), 1.7)
        .when(firms & any_part(kind, "person"), 0.55)
        .when(places & any_part(kind, "location", "city", "country", "province", "place"), 1.5)
        .otherwise(1.0)
    )


def decompose(query: Column, most: int = 4) -> Column:
    """The query and those of its clauses that have four content tokens or more, at most ``most`` (two at least)."""
    whole = F.regexp_replace(F.regexp_replace(nvl(query), r"(?U)\s+", " "), "^ | $", "")
    parts = F.split(whole, r"(?i)\s*(?:,?\s+(?:and|while|whereas|as well as|according to|as reported by)\s+|[;])\s*")
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ,.?]+|[ ,.?]+$", ""))
    whole_key = casefold(F.regexp_replace(whole, r"^[ ,.?]+|[ ,.?]+$", ""))
    good = F.filter(trimmed, lambda p: (F.size(content_tokens(p)) >= 4) & (casefold(p) != whole_key))
    first = F.size(F.filter(F.slice(trimmed, 1, 1), lambda p: (F.size(content_tokens(p)) >= 4) & (casefold(p) != whole_key)))
    extra = F.lit(most - 1) if most > 1 else first  # one clause is looked at before the bound is
    kept = F.when(extra > 0, F.slice(good, F.lit(1), F.greatest(extra, F.lit(1)))).otherwise(F.slice(good, 1, 0))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(whole), kept))
