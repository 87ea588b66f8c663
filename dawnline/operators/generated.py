"""Generated texts held against their evidence: identifiers, empty fields, quotes, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnline.functions import fixed, text

#: The fields of a generated text and the characters that are kept of each.
FIELDS = {"title_tr": 120, "summary_tr": 700, "why_tr": 400, "what_changed_tr": 400, "details_tr": 1600, "canonical_title_en": 160}
ACTIONS, ACTION_CHARS, QUOTE_CHARS = 3, 400, 240


def validated(fields: dict[str, Column], actions: Column, evidence: Column, known_kbs: Column) -> Column:
    """struct of accepted, unknown (identifiers that neither the evidence nor known_kbs has), the fields cut, and actions.

    A text with unknown identifiers, without title or without summary is not accepted, and its fields are null. actions are
    structs of text, basis and evidence_quote; the first three are kept, empty ones go, and one that claims a source whose
    quote the evidence lacks counts as inferred.
    """
    field = lambda name: F.coalesce(fields.get(name, F.lit(None).cast("string")), F.lit(""))
    advice = F.coalesce(actions, F.array().cast("array<struct<text: string, basis: string, evidence_quote: string>>"))
    said = F.concat_ws(" ", *(field(n) for n in ("title_tr", "summary_tr", "why_tr", "details_tr", "what_changed_tr")), F.array_join(advice["text"], " "))
    # what the evidence names is looked for only if the text names something, and the evidence is folded once for all quotes
    missing = lambda names, known: text.once(names, lambda n: F.when(F.size(n) == 0, n).otherwise(F.array_except(n, known)))
    updates = F.transform(missing(text.kbs(said), F.array_union(text.kbs(evidence), known_kbs)), lambda k: F.concat(F.lit("KB"), k))
    unknown = F.concat(updates, missing(text.cves(said), text.cves(evidence)))

    def checked(a: Column, folded: Column) -> Column:
        of = lambda quote, sourced: F.struct(text.truncate(a["text"], ACTION_CHARS).alias("text"), F.when(sourced, fixed.FROM_SOURCE).otherwise(fixed.INFERRED).alias("basis"), F.when(sourced, quote).otherwise("").alias("evidence_quote"))
        stands = lambda quote: F.coalesce((a["basis"] == fixed.FROM_SOURCE) & text.quoted_in(quote, folded), F.lit(False))
        return text.once(text.truncate(a["evidence_quote"], QUOTE_CHARS), lambda quote: text.once(stands(quote), lambda sourced: of(quote, sourced)))

    def result(unknown: Column, accepted: Column) -> Column:
        kept = text.once(text.norm_space(text.fold(evidence)), lambda e: F.filter(F.transform(F.slice(advice, 1, ACTIONS), lambda a: checked(a, e)), lambda a: a["text"] != ""))
        cut = [F.when(accepted, text.truncate(field(n), chars)).alias(n) for n, chars in FIELDS.items()]
        return F.struct(accepted.alias("accepted"), unknown.alias("unknown"), *cut, F.when(accepted, kept).alias("actions"))

    fits = lambda unknown: (F.size(unknown) == 0) & (text.norm_space(field("summary_tr")) != "") & (text.norm_space(field("title_tr")) != "")
    return text.once(unknown, lambda u: text.once(fits(u), lambda accepted: result(u, accepted)))
