"""Stop-word language scores as one chain of built-in expressions.

A text is sampled, split once on non-word characters and lower-cased; the words
that occur in any list are kept, and each language counts its own among them.
Intermediate values are bound with a one-element ``transform`` (see ``let``):
stacked projections would be inlined into the filter by the optimizer and
evaluated many times over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characteristic words per language, in list order.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "English": (
        "the", "of", "and", "to", "in", "is", "you", "that", "it", "he", "was", "for", "on",
        "are", "with", "as", "I", "his", "they", "be", "at", "one", "have", "this", "from", "by",
        "not", "but", "or", "an",
    ),
    "French": (
        "le", "la", "et", "un", "une", "des", "en", "du", "il", "elle", "ce", "qui", "que",
        "dans", "sur", "pour", "pas", "par", "mais", "aux", "au", "ne", "se", "est", "son", "ses",
        "ces", "mon", "ton", "nous", "été", "être", "où", "ça",
    ),
    "German": (
        "der", "die", "das", "und", "in", "zu", "von", "mit", "ist", "auf", "nicht", "ein",
        "eine", "es", "ich", "er", "sie", "wir", "ihr", "als", "auch", "für", "dem", "den",
        "nach", "bei", "noch", "wie", "über", "schön", "straße", "über", "für", "können",
    ),
    "Spanish": (
        "el", "la", "los", "las", "un", "una", "y", "o", "en", "de", "que", "con", "por", "para",
        "es", "se", "del", "al", "como", "su", "sus", "te", "le", "lo", "sí", "mi", "tú", "él",
        "años", "niño", "mañana", "está", "corazón",
    ),
    "Italian": (
        "il", "la", "e", "un", "una", "di", "che", "per", "non", "con", "si", "del", "al", "lo",
        "su", "mi", "ti", "ci", "vi", "gli", "dei", "da", "al", "ma", "o", "lui", "loro",
        "questo", "città", "perché", "questo", "dove", "anche",
    ),
    "Dutch": (
        "de", "het", "en", "een", "van", "op", "te", "dat", "die", "niet", "met", "voor", "als",
        "ook", "zijn", "aan", "bij", "door", "maar", "hij", "zij", "wij", "jullie", "hun", "dit",
    ),
    "Portuguese": (
        "o", "e", "um", "uma", "de", "em", "que", "não", "por", "para", "se", "dos", "da", "das",
        "os", "as", "eu", "tu", "ele", "ela", "nós", "vós", "eles", "elas", "te", "se", "coração",
        "país", "está", "também", "pão",
    ),
}

# Sampling and scoring parameters.
ASCII_SAMPLE = 1024
SHORT_TEXT = 4096
SAMPLE_HEAD = 2048
SAMPLE_PART = 1024
SCALE_FLOOR = 1e-6
UNCERTAIN = "Uncertain"
UNCERTAIN_SCORE = 1.0
ASCII_BAR = 0.98
LANG_BAR = 0.60

LANGUAGES: tuple[str, ...] = tuple(STOP_WORDS)
LABELS: tuple[str, ...] = (*LANGUAGES, UNCERTAIN)

_WORD_SETS = {name: sorted({w.lower() for w in ws}) for name, ws in STOP_WORDS.items()}
_ALL_WORDS = sorted(set().union(*_WORD_SETS.values()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_ratio(c: Column | str, first: int = ASCII_SAMPLE) -> Column:
    """Share of ASCII characters among the first ``first``; null for an empty text."""
    head = F.substring(_col(c), 1, first)
    kept = F.length(F.regexp_replace(head, F.lit(r"[^\x00-\x7F]+"), F.lit("")))
    return kept / F.nullif(F.length(head), F.lit(0))


def lang_sample(c: Column | str) -> Column:
    """The characters that are scored: the head, or head and middle of a long text."""
    c = _col(c)
    n = F.length(c)
    middle = F.floor(n / 2).cast("int") + 1
    return F.when(n < SHORT_TEXT, F.substring(c, 1, SAMPLE_HEAD)).otherwise(
        F.concat(F.substring(c, 1, SAMPLE_PART), F.substring(c, middle, F.lit(SAMPLE_PART)))
    )


def _words(sample: Column) -> Column:
    # Case-blind matching also equates these three letters with s, i and i.
    folded = F.lower(F.translate(sample, "ſİı", "sii"))
    return F.split(folded, r"[^\p{L}\p{N}_]+")


def _hits(sample: Column) -> Column:
    """Stop-word hits in a sample: array of ints in the order of LANGUAGES."""
    def members(of: Column, words: list[str]) -> Column:
        return F.filter(of, lambda w: w.isin(words))

    return let(
        members(_words(sample), _ALL_WORDS),
        lambda ws: F.array(*[F.size(members(ws, _WORD_SETS[k])) for k in LANGUAGES]),
    )


def _scores(sample: Column) -> Column:
    scale = F.greatest(F.length(sample) / F.lit(100.0), F.lit(SCALE_FLOOR))
    return F.concat(
        let(scale, lambda k: F.transform(_hits(sample), lambda h: h / k)),
        F.array(F.lit(UNCERTAIN_SCORE)),
    )


def _probs(sample: Column) -> Column:
    def softmax(scores: Column) -> Column:
        shifted = let(
            F.array_max(scores), lambda m: F.transform(scores, lambda s: F.exp(s - m))
        )
        return let(
            shifted,
            lambda es: let(
                F.aggregate(es, F.lit(0.0), lambda a, e: a + e),
                lambda total: F.transform(es, lambda e: e / total),
            ),
        )

    return let(_scores(sample), softmax)


def _as_map(labels: tuple[str, ...], values: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), values)


def stopword_counts(c: Column | str) -> Column:
    """Whole-word, case-blind stop-word counts of the sampled text, by language."""
    return _as_map(LANGUAGES, let(lang_sample(c), _hits))


def lang_scores(c: Column | str) -> Column:
    """Stop words per 100 characters by language, with the fixed uncertain score."""
    return _as_map(LABELS, let(lang_sample(c), _scores))


def lang_probs(c: Column | str) -> Column:
    """Softmax of the scores, by label."""
    return _as_map(LABELS, let(lang_sample(c), _probs))


def lang_ranked(c: Column | str) -> Column:
    """Labels with probabilities, most probable first; ties keep the label order."""

    def rank(probs: Column) -> Column:
        rows = F.array(
            *[
                F.struct(
                    (-probs[i]).alias("neg"), F.lit(i).alias("pos"),
                    F.lit(name).alias("lang"), probs[i].alias("p"),
                )
                for i, name in enumerate(LABELS)
            ]
        )
        return F.transform(
            F.array_sort(rows), lambda r: F.struct(r["p"].alias("p"), r["lang"].alias("lang"))
        )

    return let(let(lang_sample(c), _probs), rank)


def prob_of(c: Column | str, label: str = "English") -> Column:
    """Probability of one label."""
    i = LABELS.index(label)
    return F.element_at(let(lang_sample(c), _probs), i + 1)


def english_filter(
    df: DataFrame, text: str = "text", ascii_bar: float = ASCII_BAR, lang_bar: float = LANG_BAR,
    prob: str | None = None,
) -> DataFrame:
    """Keep rows that are nearly all ASCII and score as English.

    The cheap test comes first, so most foreign texts are never scored. Null
    and empty texts fail. ``prob`` names a column to keep the probability in.
    """
    name = prob or "_p_english"
    near_ascii = df.filter(ascii_ratio(text) > ascii_bar)
    # Exploding a one-element array pins the score: a plain column would be
    # inlined into the filter, computed twice if kept, and moved below shuffles.
    scored = near_ascii.select("*", F.explode(F.array(prob_of(text))).alias(name))
    kept = scored.filter(F.col(name) > lang_bar)
    return kept if prob else kept.drop(name)
