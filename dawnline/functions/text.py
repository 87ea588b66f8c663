"""Text normalisation, extraction and similarity as column expressions.

All stay in the JVM: what Spark lacks, compatibility decomposition (NFKD), is a translation by character, made here from
the Unicode tables. Null text counts as empty, except where a result is said to be null.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnline.functions import fixed

_HANGUL = range(0xAC00, 0xD7A4)


def _decompositions() -> tuple[str, str, list[dict[str, str]]]:
    """What NFKD without combining marks makes of single characters: those of one base, their bases, then the marks, which
    have none; and those of several, of which Hangul syllables are left out."""
    one, marks, more = {"ı": "i"}, [], []
    for code in range(0xA0, sys.maxunicode + 1):
        char = chr(code)
        if code in _HANGUL or 0xD800 <= code < 0xE000:
            continue
        if unicodedata.combining(char):
            marks.append(char)
        elif (plain := unicodedata.normalize("NFKD", char)) != char:
            base = "".join(c for c in plain if not unicodedata.combining(c))
            if len(base) == 1:
                one[char] = base
            else:
                more.append({"c": char, "d": base})
    return "".join(one) + "".join(marks), "".join(one.values()), more


_FROM, _TO, _SEVERAL = _decompositions()
_PARTED = "".join(p["c"] for p in _SEVERAL)
_SYLLABLES = "".join(map(chr, _HANGUL))
_JAMO = ["".join(chr(first + (i // below % count)) for i in range(len(_HANGUL))) for first, below, count in ((0x1100, 588, 19), (0x1161, 28, 21))]
# the third part: syllables without one come last, where translate() finds no partner and drops them
_CLOSED, _OPEN = [c for c in _SYLLABLES if (ord(c) - 0xAC00) % 28], [c for c in _SYLLABLES if not (ord(c) - 0xAC00) % 28]
_FINALS = "".join(chr(0x11A7 + (ord(c) - 0xAC00) % 28) for c in _CLOSED)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(c: Column, use) -> Column:
    """use(c) with c computed once, however often use names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def tr_lower(c: Column | str) -> Column:
    """Lower case by Turkish rules: I to ı, İ to i."""
    return F.lower(F.translate(_text(c), "Iİ", "ıi"))


def _several(c: Column) -> Column:
    """Ligatures, fractions, squared words and the like, and Hangul syllables, as their parts; only for texts that hold any."""
    pairs = F.from_json(F.lit(json.dumps(_SEVERAL)), "array<struct<c: string, d: string>>")
    ligatures = F.aggregate(F.filter(pairs, lambda p: F.contains(c, p["c"])), c, lambda text, p: F.replace(text, p["c"], p["d"]))
    # a class of so many characters is slow in a pattern; translate() looks each character up once
    parted = F.when(F.length(F.translate(c, _PARTED, "")) < F.length(c), ligatures).otherwise(c)

    def jamo(char: Column) -> Column:
        parts = [F.translate(char, _SYLLABLES, by) for by in _JAMO] + [F.translate(char, "".join(_CLOSED + _OPEN), _FINALS)]
        return F.when(char.between(_SYLLABLES[0], _SYLLABLES[-1]), F.concat(*parts)).otherwise(char)

    return once(parted, lambda p: F.when(p.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(p, ""), jamo), "")).otherwise(p))


def fold(c: Column | str) -> Column:
    """Lower case without accents: Turkish I, ı and İ are i, compatibility characters their plain parts, marks are gone."""
    plain = lambda low: F.when(low.rlike(r"[^\x00-\x7f]"), once(F.translate(low, _FROM, _TO), _several)).otherwise(low)
    return once(F.lower(_text(c)), plain)


def norm_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def norm_block(c: Column | str) -> Column:
    """Text blocks: no-break spaces plain, zero-width characters gone, spaces collapsed in lines, at most one empty line."""
    text = F.regexp_replace(F.translate(_text(c), "\u00a0", " "), "[\u200b\u200c\u200d\ufeff]", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def tokens(c: Column | str, stem: int = 5, noise: list[str] | None = None, folded: bool = False) -> Column:
    """Words of the folded text without stop words and noise, numbers of 3 digits up, words of 2 letters up, cut to stem."""
    text = c if folded else fold(c)
    dropped = sorted({*fixed.STOPWORDS, *(noise or [])})
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]{2,}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(dropped) & ((F.length(w) > 2) | w.rlike("[a-z]")))
    if not stem:
        return words
    return F.transform(words, lambda w: F.when((F.length(w) > stem) & w.rlike("[a-z]"), F.substring(w, 1, stem)).otherwise(w))


def token_set(c: Column | str, noise: list[str] | None = None) -> Column:
    return F.array_distinct(tokens(c, noise=noise))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller set within the larger; 0 if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    """Of two token sets: Jaccard, or 0.85 of the containment if both have 3 tokens."""
    small = F.least(F.size(a), F.size(b))
    return F.greatest(jaccard(a, b), F.when(small >= 3, F.lit(0.85) * containment(a, b)).otherwise(F.lit(0.0)))


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct k-word shingles of a token array; a shorter one is a single shingle; none for no tokens."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return (
        F.when(F.size(words) >= k, F.array_distinct(many))
        .when(F.size(words) > 0, F.array(F.array_join(words, " ")))
        .otherwise(F.array().cast("array<string>"))
    )


def near_duplicate(a: Column, b: Column, threshold: float = 0.6) -> Column:
    """Of two shingle sets: Jaccard from threshold or containment from 0.8 up."""
    return (jaccard(a, b) >= threshold) | (containment(a, b) >= 0.8)


def key_tokens(title: Column | str) -> Column:
    """Numbers (comma as point) and the first token of capitalised words without their suffix, distinct."""
    text = _text(title)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    names = F.regexp_extract_all(text, F.lit(r"[A-ZÇĞİÖŞÜ][\w\u00c0-\u024f]*"), F.lit(0))
    first = F.transform(names, lambda w: F.element_at(F.concat(tokens(w), F.array(F.lit(""))), 1))
    return F.array_distinct(F.concat(numbers, F.filter(first, lambda t: t != "")))


def _matches(c: Column | str, pattern: str, group: int) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(group))))


def kbs(c: Column | str) -> Column:
    return _matches(c, r"(?i)\bKB\s?(\d{6,8})\b", 1)


def cves(c: Column | str) -> Column:
    found = F.regexp_extract_all(_text(c), F.lit(r"(?i)\bCVE-\d{4}-\d{4,7}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.upper(x))))


def builds(c: Column | str) -> Column:
    majors = "|".join(sorted({b for _, _, bs in fixed.PRODUCTS for b in bs}))
    return _matches(c, rf"\b(?:{majors})\.\d{{2,5}}\b", 0)


def products(c: Column | str) -> Column:
    """Products named by pattern or by a build number, sorted and distinct."""
    text = _text(c)
    named = [F.when(text.rlike(f"(?i){p}"), F.lit(product)) for p, product in fixed.PRODUCT_PATTERNS]
    built = [F.when(text.rlike(rf"\b(?:{'|'.join(numbers)})\.\d{{2,5}}\b"), F.lit(product)) for product, _, numbers in fixed.PRODUCTS]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*named, *built))))


def sentences(c: Column | str) -> Column:
    return F.split(_text(c), r"(?<=[.!?])\s+|\n+")


def fix_kbs(c: Column | str) -> Column:
    """struct of full and partial: KBs of sentences that speak of a fix, or of a partial one only."""
    parts = sentences(c)

    def of(keep):
        return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, keep), kbs))))

    full = of(lambda s: ~s.rlike(fixed.PARTIAL_FIX))
    return F.struct(full.alias("full"), F.array_except(of(lambda s: s.rlike(fixed.PARTIAL_FIX)), full).alias("partial"))


def without_registry_warning(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), fixed.REGISTRY_WARNING, ""))


def without_negations(c: Column | str) -> Column:
    return F.array_join(F.filter(sentences(c), lambda s: ~s.rlike(fixed.NEGATED)), " ")


def padded(c: Column | str) -> Column:
    """Folded, spaces collapsed, a space before and after."""
    return F.concat(F.lit(" "), F.regexp_replace(fold(c), r"\s+", " "), F.lit(" "))


def _any_of(c: Column, words: list[str]) -> Column:
    """Whether the text holds one of these strings."""
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def has_key(text: Column, spaced: Column, keys: list[str]) -> Column:
    """Keys of up to 4 characters as words of their own, longer ones anywhere. spaced is the text with its words between single spaces."""
    short = [k.strip() for k in keys if len(k.strip()) <= 4]
    found = [F.contains(spaced, F.lit(f" {k} ")) for k in short] + [F.contains(text, F.lit(k)) for k in keys if k.strip() not in short]
    return reduce(Column.__or__, found)


def symptom_tags(c: Column | str) -> Column:
    """Tags, in their order, of which the text holds a key outside of negated sentences."""
    text = _text(c)
    # a sentence without one of these can't be a negated one
    told = F.when(_any_of(F.lower(text), fixed.NEGATED_STEMS), without_negations(text)).otherwise(text)
    both = F.transform(F.array(padded(told)), lambda t: F.struct(t.alias("t"), F.regexp_replace(t, "[^a-z0-9]+", " ").alias("w")))
    tags = F.transform(both, lambda x: F.array(*(F.when(has_key(x["t"], x["w"], keys), F.lit(tag)) for tag, keys in fixed.SYMPTOM_TAGS.items())))
    return F.array_compact(F.element_at(tags, 1))


def _lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def specific_tags(tags: Column) -> Column:
    return F.array_except(tags, _lits(fixed.WEAK_TAGS))


def role_tags(roles: Column) -> Column:
    table = F.create_map(*(x for role, tags in fixed.ROLE_TAGS.items() for x in (F.lit(role), _lits(tags))))
    return F.array_distinct(F.flatten(F.filter(F.transform(roles, lambda r: table[r]), lambda t: t.isNotNull())))


def tags_compatible(a: Column, b: Column) -> Column:
    """Whether two tag sets may speak of one issue: no specific tags on a side, or a common one that tells them from others."""
    x, y = specific_tags(a), specific_tags(b)
    common = F.array_intersect(x, y)
    broad = _lits(fixed.BROAD_TAGS)
    dx, dy = F.array_except(x, broad), F.array_except(y, broad)
    only_broad = F.size(F.array_except(common, broad)) == 0
    apart = only_broad & (F.size(dx) > 0) & (F.size(dy) > 0) & ~F.arrays_overlap(dx, dy)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(True)).when(F.size(common) == 0, F.lit(False)).otherwise(~apart)


def looks_like_issue(c: Column | str) -> Column:
    return once(padded(c), lambda t: _any_of(t, fixed.ISSUE_WORDS))


def in_scope(c: Column | str) -> Column:
    return once(padded(c), lambda t: _any_of(t, fixed.SCOPE_WORDS))


def truncate(c: Column | str, n: int) -> Column:
    """At most n characters of the space-normalised text, cut at a word with an ellipsis."""
    text = norm_space(c)
    cut = F.substring(text, 1, n - 1)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(cut, r"(?s) [^ ]*$", ""), F.lit("…")))


def first_sentences(c: Column | str, n: int = 2, chars: int = 420) -> Column:
    parts = F.split(norm_space(c), r"(?<=[.!?])\s+(?=[A-ZÇĞİÖŞÜ0-9\"'(])")
    out = F.trim(F.array_join(F.slice(parts, 1, n), " "))
    cut = F.regexp_replace(F.substring(out, 1, chars - 1), r"(?s) [^ ]*$", "")
    return F.when(F.length(out) <= chars, out).otherwise(F.concat(cut, F.lit("…")))


def slug(c: Column | str, n: int = 60) -> Column:
    """ASCII words joined by '-', at most n characters."""
    text = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(text, 1, n), "-+$", "")


def short_hash(c: Column | str, n: int = 16) -> Column:
    return F.substring(F.sha1(_text(c)), 1, n)


def language(declared: Column, text: Column | str) -> Column:
    """The declared language's first part, else 'tr' for Turkish letters, else 'en'."""
    given = F.lower(F.substring_index(declared, "-", 1))
    return F.coalesce(F.when(given != "", given), F.when(_text(text).rlike("[çğıöşüİ]"), F.lit("tr")).otherwise(F.lit("en")))


def locale_number(c: Column | str) -> Column:
    """double of '4.123,45', '41.5', '%0,12'; null if it is none."""

    def plain(text: Column) -> Column:
        comma, point = F.instr(text, ","), F.instr(text, ".")
        turkish = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        english = F.replace(text, F.lit(","), F.lit(""))
        return F.when((comma > 0) & (point > 0) & (F.length(text) - F.instr(F.reverse(text), ",") > F.length(text) - F.instr(F.reverse(text), ".")), turkish).when(
            (comma > 0) & (point > 0), english).when(comma > 0, turkish).otherwise(text).try_cast("double")

    return once(F.nullif(F.regexp_replace(_text(c), "[%\\s\u00a0\u20ba$\u20ac]", ""), F.lit("")), plain)


def quoted(quote: Column, evidence: Column) -> Column:
    """Whether a quote of 8 characters up stands in a text: as a folded string, or by 90 % of its words, if it has 3."""
    return once(norm_space(fold(evidence)), lambda e: quoted_in(quote, e))


def quoted_in(quote: Column, folded: Column) -> Column:
    """quoted() in a text that is folded and whose spaces are collapsed; its words are told apart only if the quote is no part of it."""
    marks = " .\"'“”"

    def by_words(words: Column) -> Column:
        known = F.array_distinct(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0)))
        found = once(known, lambda k: F.size(F.filter(words, lambda w: F.array_contains(k, w))))
        return F.when(F.size(words) >= 3, found >= 0.9 * F.size(words)).otherwise(F.lit(False))

    words = lambda q: F.regexp_extract_all(q, F.lit("[a-z0-9]+"), F.lit(0))
    told = lambda q: F.when(F.length(q) < 8, F.lit(False)).when(F.contains(folded, q), F.lit(True)).otherwise(once(words(q), by_words))
    return once(F.regexp_replace(norm_space(fold(quote)), f"^[{marks}]+|[{marks}]+$", ""), told)


def content_hash(*columns: Column | str) -> Column:
    """sha256 of the columns' JSON, keys in order; nulls count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def semantic_hash(fields: dict[str, Column], workaround: Column) -> Column:
    """sha256 of the fields that carry meaning (those of fixed.SEMANTIC_FIELDS that are given) and of whether there is a workaround."""
    told = [fields[name].alias(name) for name in sorted(fields) if name in fixed.SEMANTIC_FIELDS]
    return content_hash(F.struct(*told, (F.trim(_text(workaround)) != "").alias("_wa")))


def state_hash(state: dict[str, Column]) -> Column:
    """sha256 of a state without what is only told of it (meta)."""
    return content_hash(F.struct(*(state[name].alias(name) for name in sorted(state) if name != "meta")))
