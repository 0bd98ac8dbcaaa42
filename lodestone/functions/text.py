"""Text functions as Column expressions."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual 33 English stop words of full-text engines.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-cased runs of a-z and 0-9; null text has no tokens."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def word_tokens(text) -> Column:
    """Runs of Unicode letters, digits and underscores, case kept."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def without_stop_words(toks: Column, words=STOP_WORDS) -> Column:
    return F.filter(toks, lambda t: ~t.isin(*words))


def without_possessive(text) -> Column:
    """The text without the possessive ending of its words."""
    return F.regexp_replace(_col(text), r"['’][sS](?![\\p{L}\\p{N}_])", "")


def prefixed(text, prefix: str) -> Column:
    """``prefix`` in front of the text; the text itself when the prefix is empty."""
    return F.concat(F.lit(prefix), _col(text)) if prefix else _col(text)


def pad(toks, length: int | Column, filler: str = "") -> Column:
    """Cut or fill to exactly ``length`` elements."""
    n = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(_col(toks), F.lit(1), n)
    return F.concat(cut, F.array_repeat(F.lit(filler), n - F.size(cut)))


def length_mask(length, n: int) -> Column:
    """``n`` booleans, true in front of ``length``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < _col(length))


def optional_slice(seq, start: int, stop: int | None) -> Column:
    """Elements start <= i < stop, counted from 0; null stays null."""
    c = _col(seq)
    return F.slice(c, start + 1, (F.lit(stop) if stop is not None else F.greatest(F.size(c), F.lit(0))) - start)


def truncate_pair(query, document, max_query: int, max_document: int, max_total: int, specials: int = 3) -> tuple[Column, Column]:
    """Token arrays cut to their own limits, then to ``max_total - specials``: the document gives way first."""
    q, d = F.slice(_col(query), 1, max_query), F.slice(_col(document), 1, max_document)
    room = max_total - specials
    keep_d = F.greatest(F.lit(0), F.least(F.size(d), room - F.size(q)))
    keep_q = F.least(F.size(q), room - keep_d)
    return F.slice(q, F.lit(1), keep_q), F.slice(d, F.lit(1), keep_d)


def prompt(query, document, max_query: int, max_document: int) -> Column:
    """Relevance prompt from token arrays, each cut to its budget."""
    part = lambda c, n: F.array_join(F.slice(_col(c), 1, n), " ")
    return F.format_string("Query: %s Document: %s Relevant:", part(query, max_query), part(document, max_document))


def one_hot(toks, max_length: int, specials=("[PAD]", "[SEP]", "[CLS]")) -> Column:
    """Distinct tokens of the first ``max_length``, without special ones."""
    return F.filter(F.array_distinct(F.slice(_col(toks), 1, max_length)), lambda t: ~t.isin(*specials))


def tsv_safe(text) -> Column:
    return F.regexp_replace(_col(text), "[\t\r\n]", " ")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(stem: str) -> int:
    """Changes from a vowel to a consonant."""
    return sum(_vowel(stem, i - 1) and not _vowel(stem, i) for i in range(1, len(stem)))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and w[-1] not in "wxy" and _vowel(w, n - 2) and not _vowel(w, n - 3)


#: The suffix tables of the published Porter algorithm, steps 2 to 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(w: str) -> str:
    """Stem of a lower-case word by Porter's algorithm.

    >>> [porter(w) for w in ("caresses", "hopping", "relational", "adjustment")]
    ['caress', 'hop', 'relat', 'adjust']
    """
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max((x for x in table if w.endswith(x[0])), key=lambda x: len(x[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]):
            w = w[: -len(hit[0])] + hit[1]
    hit = max((x for x in _STEP4 if w.endswith(x)), key=len, default=None)
    if hit and _measure(stem := w[: -len(hit)]) > 1 and (hit != "ion" or stem.endswith(("s", "t"))):
        w = stem
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _stems(col: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return col.map(lambda ws: [known[w] if w in known else known.setdefault(w, porter(w)) for w in ws])


def stemmed(toks: Column, stem: str = "porter") -> Column:
    """Stems of a token array by a named stemmer, in an Arrow-batched function that stems each distinct word once."""
    if stem != "porter":
        raise ValueError(f"no stemmer {stem!r}; known is 'porter'")
    return F.pandas_udf(_stems, "array<string>")(toks)
