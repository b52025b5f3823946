"""Text expressions on which everything else is defined.  All are built-in column functions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_'-]+"

# The words that carry no content (English and Russian).
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were",
    "with", "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же",
    "вы", "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от", "меня",
)

# Letters that can begin a name, and those of words.
NAME_START, WORD_CHARS = "A-ZА-ЯЁ", r"\p{L}\p{N}_"
NAME_WORD = f"[{NAME_START}](?:[{WORD_CHARS}-]*[{WORD_CHARS}])?"
NAME = rf"(?:^|[^{WORD_CHARS}])({NAME_WORD}(?:\s+{NAME_WORD}){{0,4}})"
#: The same names, found by their first letter: what is before it is looked at only there.
NAME_AT = rf"([{NAME_START}](?<![{WORD_CHARS}][{NAME_START}])(?:[{WORD_CHARS}-]*[{WORD_CHARS}])?(?:\s+{NAME_WORD}){{0,4}})"


def nvl(c: Column | str, value="") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(value))


def tokens(text: Column) -> Column:
    """Words of a text (letters, digits, _, ' and -), lower case, in order."""
    return F.transform(F.regexp_extract_all(nvl(text), F.lit(TOKEN), F.lit(0)), F.lower)


def content_tokens(text: Column) -> Column:
    """Tokens of more than one character that are no stop words."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Pieces between line breaks, or after . ! or ? and white space; stripped, none empty."""
    pieces = F.split(nvl(text), r"(?U)(?=\s)(?:(?<=[.!?])\s+|\n+)")
    plain = r"^[\x21-\x7e](?s:.*[\x21-\x7e])?\z"  # most pieces: nothing to strip
    return F.filter(F.transform(pieces, lambda s: F.when(s.rlike(plain), s).otherwise(strip(s))), lambda s: s != "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(nvl(text), F.lit(r"(?U)\S+"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens of a language model: 1.25 per word, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.size(tokens(text)) * F.lit(1.25))).cast("long")


def stable_id(prefix: str, *values: Column) -> Column:
    """``prefix_`` and 16 hex digits of the SHA-1 of the values joined by U+001F (null: empty)."""
    joined = F.concat_ws("\x1f", *[nvl(v.cast("string")) for v in values])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined.cast("binary")), 1, 16))


def casefold(text: Column) -> Column:
    """Lower case with the two foldings that matter in our texts: sharp s and final sigma."""
    return F.replace(F.replace(F.lower(nvl(text)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def entity_key(text: Column) -> Column:
    """Casefolded text without anything but letters, digits and _."""
    return F.regexp_replace(casefold(text), rf"[^{WORD_CHARS}]+", "")


def truncate_to_tokens(text: Column, limit: Column | int) -> Column:
    """The first words of a text that fit into ``limit`` estimated tokens; one word at least unless the limit is 0."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    kept = F.array_join(F.slice(words(text), F.lit(1), F.greatest(F.lit(1), F.floor(n / F.lit(1.25)).cast("int"))), " ")
    return F.when(n <= 0, F.lit("")).otherwise(kept)


def names(sentence: Column) -> Column:
    """Runs of one to five capitalised words, distinct, in order of appearance, longer than one character."""
    found = F.transform(F.regexp_extract_all(nvl(sentence), F.lit(NAME_AT), F.lit(1)), strip)
    return F.array_distinct(F.filter(found, lambda n: F.length(n) > 1))


def token_counts(tokens_: Column) -> Column:
    """map<token, count>."""
    return F.map_from_entries(F.transform(F.array_distinct(tokens_), lambda t: F.struct(t, F.size(F.filter(tokens_, lambda x: x == t)).cast("double"))))


def lexical_similarity(left: Column, right: Column) -> Column:
    """Cosine of the content-token counts of two texts; 0 if one has none."""
    a, b = content_tokens(left), content_tokens(right)
    return lexical_of(a, b)


def squares(tokens_: Column) -> Column:
    """Sum of the squared counts of the tokens: one walk over the sorted tokens, a run of n of them adds 1 + 3 + .. = n * n."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total"))

    def step(state: Column, token: Column) -> Column:
        run = F.when(token == state["last"], state["run"]).otherwise(F.lit(0))
        return F.struct(token.alias("last"), (run + 1).alias("run"), (state["total"] + 2 * run + 1).alias("total"))

    return F.aggregate(F.sort_array(tokens_), start, step, lambda state: state["total"])


def lexical_of(a: Column, b: Column) -> Column:
    """The same for arrays of content tokens, which should be columns: an expression would be computed for every token."""
    count = lambda t, of: F.size(F.filter(of, lambda x: x == t)).cast("double")
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, t: s + count(t, a) * count(t, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (F.sqrt(squares(a)) * F.sqrt(squares(b)))).otherwise(F.lit(0.0))


def subset(a: Column, b: Column) -> Column:
    """Whether array ``a`` has members and all are in ``b``."""
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)
