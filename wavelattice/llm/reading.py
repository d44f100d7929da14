"""Reading level of each page's article: grade formulas, their median, and bands fitted to labelled pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from math import log
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelattice.llm.pages import is_broken, joined, page_columns, restored_lines
from wavelattice.session import cut_lineage

# Marks of advertisements, price lists and page heads in newspapers of the period.
_PRICE = re.compile(r"\b[\dOlI]{1,3} ?s\. ?[\dOlI]{1,2} ?d\b|[£$]\s?\d|\bPRICE\b.{0,4}\d+ ?d\b")
_LEADER = re.compile(r"\.{2,}\s*\d|\.{4,}|\b\d+[½¼¾]|(?:\* ?){2,}|^\s*\*\s*$")
_HEAD = re.compile(r"^\s*(?:No\.|Vol\.|Page)\s*\d+", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?]+[\"'”’)\]]*\s+(?=[\"'“‘(\[]*[A-Z0-9])|[.!?]+\s*$")
_VOWELS = re.compile(r"[aeiouyàâäéèêëîïôöûü]+")


_NOTICE = re.compile(r"^\W*[A-Z]{4,},")
_PLAIN_WORDS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~‘’“”‐¬"} | {a: b for a, b in zip("0156", "olsg")})
_NO_LOWER = {i: None for i in range(ord("a"), ord("z") + 1)}


def line_words(line: str) -> list[str]:
    """Words of a line for its statistics: lower case, signs as blanks, digits that are misread letters as letters."""
    return line.lower().translate(_PLAIN_WORDS).split()


def count_lines(lines: Sequence[str], reach: int, near: Counter, far: Counter) -> tuple[int, int]:
    """Adds the words of a page's plain lines to ``near`` or ``far``, and returns the numbers of such lines.

    Near are lines at most ``reach`` lines from one that its layout shows to be an advert's (price, leaders, capitals,
    stars, a notice's first word), far are those more than twice that away; the others teach nothing.
    """
    marks = [_mark(line, None) for line in lines]
    n = len(lines)
    gap = [n] * n
    for order in (range(n), range(n - 1, -1, -1)):
        d = n
        for i in order:
            d = 0 if marks[i] in (1, 2) else d + 1
            gap[i] = min(gap[i], d)
    sums = [0, 0]
    for i in range(n):
        if marks[i] == 0:
            side = 0 if gap[i] <= reach else 1 if gap[i] > 2 * reach else None
            if side is not None:
                sums[side] += 1
                (near, far)[side].update(set(line_words(lines[i])))
    return sums[0], sums[1]


def word_odds(near: Counter, far: Counter, n_near: int, n_far: int, least: int = 5, prior: float = 10.0) -> dict[str, float]:
    """Log odds that a line with the word stands in an advert, of words on at least ``least`` lines, between -3 and 4.

    ``prior`` lines of no opinion are added to each word, so that rare words say little.
    """
    out = {}
    share = (n_near + 1) / (n_near + n_far + 2)
    for w in near.keys() | far.keys():
        if near[w] + far[w] >= least:
            odds = log((near[w] + prior * share) / (n_near + 1)) - log((far[w] + prior * (1 - share)) / (n_far + 1))
            out[w] = round(min(4.0, max(-3.0, odds)), 4)
    return out


def learn_adverts(pages: DataFrame, reach: int = 2, least: int = 5) -> dict[str, float]:
    """``word_odds`` learnt from the pages of ``page_columns`` by layout alone, without any list of phrases.

    Words are counted per partition and summed; those on fewer than ``least`` lines stay behind, so
    what comes back is bounded by the vocabulary of the given pages, which grows far slower than they do.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, far = Counter(), Counter()
        a = b = 0
        for pdf in batches:
            for page, x, y in zip(pdf["text"], pdf["x"], pdf["y"]):
                if isinstance(page, str):
                    m, n = count_lines(restored_lines(page, x, y), reach, near, far)
                    a, b = a + m, b + n
        rows = [(w, near[w], far[w]) for w in near.keys() | far.keys()] + [("", a, b)]
        yield pd.DataFrame(rows, columns=["w", "near", "far"])

    counts = pages.mapInPandas(scan, "w string, near long, far long").groupBy("w").agg(F.sum("near").alias("near"), F.sum("far").alias("far"))
    rows = counts.where((F.col("near") + F.col("far") >= least) | (F.col("w") == "")).collect()
    total = next(((r.near, r.far) for r in rows if r.w == ""), (0, 0))
    return word_odds(Counter({r.w: r.near for r in rows if r.w}), Counter({r.w: r.far for r in rows if r.w}), *total, least)


#: Summed log odds beyond which a line is an advert's.
ADVERT = 2.0


def matter_of(lines: Sequence[str], memo: dict[str, int] | None = None, odds: dict[str, float] | None = None) -> list[bool]:
    """For each line in reading order, whether it belongs to the article.

    A line is other matter when it bears a price, leaders or a page head, is set in
    capitals only, or its words are those of adverts by ``odds``; so is a short line right after such a line
    that doesn't go on as a sentence of the article, and what follows a heading of an advert.
    """
    memo = {} if memo is None else memo
    marks = []
    for line in lines:
        m = memo.get(line)
        if m is None:
            m = memo[line] = _mark(line, odds)
        marks.append(m)
    n = len(lines)
    # Words alone make a line an advert's only beside another line of one.
    if 4 in marks:
        marks = [m if m != 4 else 1 if any(marks[j] in (1, 2, 4) for j in (i - 1, i + 1) if 0 <= j < n) else 0 for i, m in enumerate(marks)]
    out = [m == 0 for m in marks]
    for i in range(n):
        if out[i]:
            words = len(lines[i].split())
            beside = (i > 0 and marks[i - 1] > 0) or (i + 1 < n and marks[i + 1] > 0)
            before = i > 0 and not out[i - 1] and marks[i - 1] != 3
            # a heading of an advert is followed by its firm; an ad's last line may be a word or two
            if before and marks[i - 1] == 2 and words <= 5 and not is_broken(lines[i]):
                out[i] = False
            elif before and words <= 2 and beside and not is_broken(lines[i]) and lines[i].rstrip()[-1:] in ".!" and _unfinished(lines, out, i):
                out[i] = False
    return out


def _unfinished(lines: Sequence[str], out: list[bool], i: int) -> bool:
    """Whether the article had no sentence open before line ``i`` (so a short line can't end it)."""
    j = i - 1
    while j >= 0 and not out[j]:
        j -= 1
    return j < 0 or lines[j].rstrip()[-1:] in ".!?\"'"


def _mark(line: str, odds: dict[str, float] | None) -> int:
    """0 plain, 1 advert, 2 heading of an advert or article (capitals, stars), 3 page head, 4 advert by its words."""
    if not line or line.isspace():
        return 3
    if "s." in line or "d." in line or "PRICE" in line or "$" in line or "£" in line or ".." in line or "*" in line or any(c in line for c in "½¼¾"):
        if _HEAD.match(line):
            return 3
        if _PRICE.search(line) or (_LEADER.search(line) and "*" not in line):
            return 1
        if "*" in line and _LEADER.search(line):
            return 2
    rest = len(line.translate(_NO_LOWER))
    if rest > 0.6 * len(line):
        bare = [c for c in line if c.isalpha()]
        if len(bare) >= 3 and sum(c.isupper() for c in bare) >= 0.8 * len(bare):
            return 3 if line.upper().startswith("NEW") else 2
        if not bare:
            return 1
        if _HEAD.match(line):
            return 3
    if _NOTICE.match(line):
        return 1
    return 4 if odds and sum(odds.get(w, 0.0) for w in line_words(line)) > ADVERT else 0


def syllables(word: str) -> int:
    """Syllables by hyphenation-style rules: vowel groups, less silent endings, plus split vowels."""
    w = word.lower().replace("'", "").replace("’", "")
    n = len(_VOWELS.findall(w))
    if len(w) > 2 and w.endswith("e") and not w.endswith(("le", "ee", "ie", "ye", "oe")):
        n -= 1
    elif len(w) > 3 and w.endswith("le") and w[-3] in "aeiouy":
        n -= 1
    if len(w) > 3 and w.endswith(("es", "ed")) and not w.endswith(("ted", "ded", "ses", "zes", "ces", "ges", "ches", "shes", "xes", "ees", "ied", "ies", "eed", "les", "led")):
        n -= 1
    for pair in ("ia", "io", "eo", "ua", "uo", "iu", "ii"):
        at = w.find(pair)
        if at > 0 and not (pair in ("io", "ia") and w[at - 1] in "tscxg") and not (pair in ("ua", "uo") and w[at - 1] in "qg"):
            n += 1
    return max(1, n)


#: Names of the measures of a text, in the order of ``measures``.
MEASURES = ("syllables", "hard", "very_hard", "letters", "long", "very_long", "letters_sd", "sentence", "grade")


def measures(words: Sequence[str], sentences: int, memo: dict[str, tuple[int, int]] | None = None, longest: float = 60.0) -> tuple[float, ...]:
    """Measures of a text; the last is the median of six school grades by classic formulas.

    The formulas are Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau, automated readability
    and LIX (scaled to grades).  Full stops are often lost in scanning, so the mean
    sentence counts as at most ``longest`` words.  An empty text has zeros throughout.
    """
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    memo = {} if memo is None else memo
    often = Counter(words)
    pairs = []
    for w in often:
        k = memo.get(w)
        if k is None:
            k = (syllables(w), len(w))
            if len(memo) < 500_000:  # only a cache
                memo[w] = k
        pairs.append(k)
    both, share = np.array(pairs, dtype=np.float64), np.fromiter(often.values(), np.float64, len(often)) / n
    syl, size = both[:, 0], both[:, 1]
    length = min(longest, n / max(1, sentences))
    per_word, hard, letters_mean, long = share @ syl, share @ (syl >= 3), share @ size, share @ (size > 6)
    spread = max(0.0, share @ (size * size) - letters_mean * letters_mean) ** 0.5
    grade = median(
        (
            0.39 * length + 11.8 * per_word - 15.59,
            0.4 * (length + 100 * hard),
            1.043 * (30 * hard * length) ** 0.5 + 3.1291,
            5.88 * letters_mean - 29.6 / length - 15.8,
            4.71 * letters_mean + 0.5 * length - 21.43,
            (length + 100 * long - 10) / 4.5,
        )
    )
    return tuple(float(v) for v in (per_word, hard, share @ (syl >= 4), letters_mean, long, share @ (size > 9), spread, np.log(length), grade))


# Function words that tell the four languages apart.
_FUNCTION_WORDS = {
    "en": frozenset("the of and to in that it is was for with on his her by at this not you had has have which from but".split()),
    "fr": frozenset("le la les des du et un une dans est pour que qui ne pas sur au aux se ce il elle sont".split()),
    "es": frozenset("el la los las de del y un una en es por que con no se su al lo para como".split()),
    "de": frozenset("der die das und ein eine in ist von zu mit den dem nicht auf für sich des im es auch".split()),
}


def is_english(words: Sequence[str]) -> bool:
    """Whether English function words outnumber those of each other language."""
    counts = {k: sum(map(v.__contains__, words)) for k, v in _FUNCTION_WORDS.items()}
    return counts["en"] > 0 and counts["en"] >= max(counts.values())


def article_words(text: str, x, y, marks: dict[str, int] | None = None, odds: dict[str, float] | None = None) -> tuple[list[str], int]:
    """Words and number of sentences of a page's article, the whole page read."""
    lines = restored_lines(text, x, y)
    keep = matter_of(lines, marks, odds)
    run = joined([line for line, k in zip(lines, keep) if k])
    return [w.lower() for w in _WORD.findall(run)], len(_SENTENCE.findall(run + " "))


def english_label(lang: Column) -> Column:
    """Whether a language label is English in any spelling (en, EN, eng, English, en-GB, ...)."""
    return F.coalesce(F.lower(F.trim(lang)).rlike(r"^(en|eng|english)([-_ ].*)?$"), F.lit(False))


def reading_measures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", boxes: str | None = "line_boxes", odds: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, n_words bigint, english boolean`` and the ``MEASURES`` of every page's article.

    One pass without exchange over whole texts; ``odds`` (see ``learn_adverts``) tell adverts that no layout shows.  Null and empty texts give a row with no words
    and null measures; repeated doc_ids give repeated rows; other columns are ignored.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks: dict[str, int] = {}
        memo: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            if len(marks) > 200_000:  # only a cache
                marks.clear()
            rows = []
            for doc, page, x, y in zip(pdf["doc_id"], pdf["text"], pdf["x"], pdf["y"]):
                words, sentences = article_words(page, x, y, marks, odds) if isinstance(page, str) else ([], 0)
                rows.append((doc, len(words), is_english(words), *(measures(words, sentences, memo) if words else (None,) * len(MEASURES))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "english", *MEASURES])

    schema = "doc_id long, n_words long, english boolean, " + ", ".join(f"{m} double" for m in MEASURES)
    return page_columns(df, doc_id, text, boxes).where(F.col("doc_id").isNotNull()).mapInPandas(scan, schema)


def _sums(x: np.ndarray, bands: np.ndarray, classes: Sequence[int], mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the softmax regression at ``w``, summed over the rows, as one flat array."""
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    p, k = w.shape
    hit = bands[:, None] == np.array(classes)[None, :]
    s = z @ w
    s -= s.max(1, keepdims=True)
    q = np.exp(s)
    total = q.sum(1, keepdims=True)
    q /= total
    hess = np.empty((p, k, p, k))
    for a in range(k):
        for b in range(a, k):
            hess[:, a, :, b] = hess[:, b, :, a] = z.T @ (z * (q[:, a] * ((a == b) - q[:, b]))[:, None])
    return np.concatenate(([np.log(total).sum() - s[hit].sum()], (z.T @ (q - hit)).ravel(), hess.ravel()))


def _least(sums: Callable[[np.ndarray], np.ndarray], n: int, p: int, k: int, ridge: float, steps: int = 50, near: float = 1e-9) -> np.ndarray:
    """Weights of the least mean loss, by Newton's method; ``sums`` gives ``_sums`` of all ``n`` rows at given weights."""
    held = np.full((p, k), ridge)
    held[0] = 0.0

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        flat = sums(w) / n
        hess = flat[1 + p * k :].reshape(p * k, p * k) + np.diag(held.ravel())
        hess[:k, :k] += 1.0 / k  # a constant added to all classes changes nothing; this keeps the matrix regular
        return flat[0] + 0.5 * (held * w * w).sum(), flat[1 : 1 + p * k].reshape(p, k) + held * w, hess

    w = np.zeros((p, k))
    loss, slope, hess = at(w)
    for _ in range(steps):
        if np.abs(slope).max() <= near:
            break
        way, t = np.linalg.solve(hess, slope.ravel()).reshape(p, k), 1.0
        now = at(w - way)
        while now[0] > loss + 1e-12 and t > 1e-3:
            t /= 2
            now = at(w - t * way)
        w = w - t * way
        loss, slope, hess = now
    return w


def fit_bands(table: pd.DataFrame, label: str = "band", names: Sequence[str] = MEASURES, ridge: float = 1e-3) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Softmax regression of the band on the standardised measures: classes, mean, scale, weights."""
    table = table.dropna(subset=[label, *names]).sort_values([label, *names])
    classes = sorted({int(b) for b in table[label]})
    if not classes:
        return [], np.zeros(len(names)), np.ones(len(names)), np.zeros((len(names) + 1, 0))
    x, bands = table[list(names)].to_numpy(dtype=np.float64), table[label].to_numpy(dtype=np.int64)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return classes, mean, scale, _least(lambda w: _sums(x, bands, classes, mean, scale, w), len(x), len(names) + 1, len(classes), ridge)


def fit_spread_bands(lessons: DataFrame, label: str = "band", names: Sequence[str] = MEASURES, ridge: float = 1e-3) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """``fit_bands`` over a table of any size, which is read once a step: every partition sends only its sums.

    The table should be kept and have a bounded number of partitions.
    """
    names = list(names)
    lessons = lessons.select(F.col(label).cast("int").alias("label"), *names).dropna()
    stats = lessons.agg(F.count(F.lit(1)).alias("n"), F.collect_set("label").alias("bands"), *[F.avg(m).alias(f"mean_{m}") for m in names], *[F.stddev_pop(m).alias(f"sd_{m}") for m in names]).first()
    classes = sorted(stats["bands"])
    if not classes:
        return [], np.zeros(len(names)), np.ones(len(names)), np.zeros((len(names) + 1, 0))
    mean, scale = np.array([stats[f"mean_{m}"] for m in names]), np.array([stats[f"sd_{m}"] for m in names]) + 1e-9

    def sums(w: np.ndarray) -> np.ndarray:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                if len(pdf):
                    own = _sums(pdf[names].to_numpy(dtype=np.float64), pdf["label"].to_numpy(dtype=np.int64), classes, mean, scale, w)
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"sums": [total.tolist()]})

        return np.sum([r["sums"] for r in lessons.mapInPandas(scan, "sums array<double>").collect()], axis=0)

    return classes, mean, scale, _least(sums, stats["n"], len(names) + 1, len(classes), ridge)


def band_expression(model: tuple[list[int], np.ndarray, np.ndarray, np.ndarray], names: Sequence[str] = MEASURES) -> Column:
    """The fitted band as a column of the measures (null where a measure is null)."""
    classes, mean, scale, w = model
    if not classes:
        return F.lit(None).cast("int")
    scores = []
    for j in range(len(classes)):
        s = F.lit(float(w[0, j]))
        for i, m in enumerate(names):
            s = s + (F.col(m) - float(mean[i])) * float(w[i + 1, j] / scale[i])
        scores.append(s)
    best = F.array_max(F.array(*scores)) if len(scores) > 1 else scores[0]
    out = F.lit(None).cast("int")
    for c, s in zip(reversed(classes), reversed(scores)):
        out = F.when(s == best, F.lit(c)).otherwise(out)
    return out


def reading_bands(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    boxes: str | None = "line_boxes",
    band: str = "band",
    min_words: int = 75,
    names: Sequence[str] = MEASURES,
    broadcast_bytes: int = 32_000_000,
) -> DataFrame:
    """``doc_id, band int, grade double, n_words`` of every English page that carries an article, labelled ones left out.

    What adverts say is learnt from all labelled pages by layout alone, and the classifier is fitted on the ``names``
    measures of all of them (``grade`` alone: the median of the formulas); every other page is judged with it.  Labels go
    to all tasks where they take at most ``broadcast_bytes``, else pages and labels are joined by an exchange.  Pages whose label isn't English, whose
    article has fewer than ``min_words`` words or isn't English prose, and null texts give no row.
    Without any labelled page no band can be told and the result is empty.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(band).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(band).cast("int").alias("label"))
    known = cut_lineage(known)
    n_labels = known.count()
    held = F.broadcast(known) if 16 * n_labels <= broadcast_bytes else known
    pages = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), *([F.col(boxes).alias("line_boxes")] if boxes and boxes in documents.columns else []))
    english = pages.where(english_label(F.col("lang")))
    odds = learn_adverts(page_columns(english.join(held, "doc_id", "left_semi"), "doc_id", "text", "line_boxes"))
    # Each page is read once; its few numbers are kept, with its label, for fitting and for judging.
    rest = cut_lineage(reading_measures(english, odds=odds).where((F.col("n_words") >= min_words) & F.col("english")).join(held, "doc_id", "left"))
    lessons = cut_lineage(rest.where(F.col("label").isNotNull()).select("doc_id", "label", *names).repartition(min(256, 1 + n_labels // 50_000), "doc_id"))
    model = fit_spread_bands(lessons, "label", names)
    judged = rest.where(F.col("label").isNull())
    return judged.select("doc_id", band_expression(model, names).alias("band"), "grade", "n_words").where(F.col("band").isNotNull())
