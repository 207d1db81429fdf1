"""Text functions: tokens, tool texts, string similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no tokens.
STOPWORDS = (
    "the and for with from that this will have has are was were use used using get info data tool tools task tasks search query retrieve"
    " provide return returns based specific including include user users help details information of to in is by on as or if not via name id"
    " email phone address date amount record records string number numbers value values result results status status_code city country state"
    " province region code show"
).split()
#: Words that say nothing about a cluster.
GENERIC = "tool task query search get retrieve information data info details use used".split()


def tokens(text: Column) -> Column:
    """Lower-case tokens of a letter or digit and letters, digits and underscores, in order.

    Word ends are those of Unicode, so a run with an accented letter is no token; stop words,
    tokens of one or two characters and numbers are left out.
    """
    return F.filter(words(text), is_token)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, of which `is_token` tells the tokens."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def is_token(word: Column) -> Column:
    return word.rlike("^[a-z0-9][a-z0-9_]*$") & (F.length(word) > 2) & ~word.rlike("^[0-9]+$") & ~word.isin(STOPWORDS)


def squeezed(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def tool_text(name: Column, description: Column, parameters: Column, required: Column) -> Column:
    """A tool as lines of text.

    parameters: array of struct(name, type, description, options), in any order; required:
    array of names, in the order to show.
    """
    by_name = F.array_sort(parameters, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))

    def line(p: Column) -> Column:
        head = F.concat(F.lit("- "), p["name"], F.lit(" ("), F.coalesce(p["type"], F.lit("string")), F.lit("): "), F.coalesce(p["description"], F.lit("")))
        quoted = F.array_join(F.transform(p["options"], lambda o: F.concat(F.lit("'"), o, F.lit("'"))), ", ")
        return F.when(F.size(p["options"]) > 0, F.concat(head, F.lit(" Options=["), quoted, F.lit("]."))).otherwise(head)

    lines = F.transform(by_name, line)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Tool: "), F.coalesce(name, F.lit(""))),
        F.concat(F.lit("Description: "), F.coalesce(description, F.lit(""))),
        F.when(F.size(parameters) > 0, F.concat(F.lit("Parameters:\n"), F.array_join(lines, "\n"))),
        F.when(F.size(required) > 0, F.concat(F.lit("Required: "), F.array_join(required, ", "))),
    )


def with_examples(text: Column, tasks: Column, most: int = 3) -> Column:
    """A tool's text with its first tasks."""
    shown = F.array_join(F.slice(tasks, 1, most), " | ")
    return F.when(F.size(tasks) > 0, F.concat(text, F.lit("\nExample tasks: "), shown)).otherwise(text)


def matches_search(name: Column, description: Column, needle: str) -> Column:
    """Whether a lower-cased search text is in a name or description."""
    low = needle.lower()
    return F.coalesce(F.lower(name).contains(low), F.lit(False)) | F.coalesce(F.lower(description).contains(low), F.lit(False))


# ---- plain functions, for use within UDFs ----


def ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's similarity of two strings, 0 to 1."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def common_words(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence with b."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    i, j, places = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            places.add(i - 1)
            i, j = i - 1, j - 1
        elif best[i - 1][j] > best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return places


def rouge_l(hypothesis: str, reference: str) -> float:
    """ROUGE-L at summary level: F-measure of the union of longest common subsequences.

    Sentences end at full stops.  For each sentence of the reference, the words that any
    sentence of the hypothesis shares in order count once; both sides count distinct words.
    """
    split = lambda s: [p.split() for p in s.split(".") if p.split()]
    hyp, ref = split(hypothesis), split(reference)
    if not hyp or not ref:
        raise ValueError("a text without words")
    shared: set[str] = set()
    for sentence in ref:
        for other in hyp:
            shared |= {sentence[i] for i in common_words(sentence, other)}
    m, n = len({w for s in ref for w in s}), len({w for s in hyp for w in s})
    precision, recall = len(shared) / n, len(shared) / m
    return 2 * precision * recall / (precision + recall + 1e-8)


def han_spaced(text: str) -> str:
    """Each Han character as a word of its own: the default where no segmenter is given."""
    return " ".join("".join(f" {c} " if "一" <= c <= "龥" else c for c in text).split())


def has_han(text: str) -> bool:
    return any("一" <= c <= "龥" for c in text)


Segmenter = Callable[[str], str]
