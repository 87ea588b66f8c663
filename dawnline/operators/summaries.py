"""Summaries, reasons and actions of events, by rules.

A rule is a row: the field that it writes, the kinds that it is for, a condition, a template, and, of an action, the basis and the
quote that it rests on. Rules are compiled to one expression a field, so that a text and its provenance come from the same row;
of rules of one choice the first that holds counts. Templates name columns, which are computed once a row before.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.functions import dates, fixed, text

TITLE_CHARS, SUMMARY_CHARS = 160, 900
SOURCE, RULE = fixed.FROM_SOURCE, "kural"
ANY = ("issue", "release", "feature", "notice", "version", "hotfix", "news", "content")
OTHER = ("news", "content")  # and any kind that is not heard of


@dataclass(frozen=True)
class Rule:
    """when is SQL over the prepared columns. Rules of one field that follow each other with the same choice exclude each other."""

    field: str
    kinds: tuple[str, ...]
    when: str
    template: str
    basis: str = ""
    quote: str = ""
    choice: str = ""


#: The texts.
RULES = [
    Rule("title", ("release",), "true", "KB{kb} — {release_name}", choice="title"),
    Rule("title", ("version",), "track <=> 'tp'", "{own_title}", choice="title"),
    Rule("title", ("version",), "days_left < 0", "ConfigMgr {version}: destek sona erdi", choice="title"),
    Rule("title", ("version",), "days_left is not null", "ConfigMgr {version}: destek bitişine {days_left} gün", choice="title"),
    Rule("title", ("version",), "true", "ConfigMgr {version}: sürüm bilgisi", choice="title"),
    Rule("title", ANY, "true", "{own_title}", choice="title"),
    Rule("summary", ("issue",), "origin_names <> ''", "{origin_names} sonrasında bildirilen sorun", choice="begin"),
    Rule("summary", ("issue",), "true", "Bildirilen sorun", choice="begin"),
    Rule("summary", ("issue",), "tag_names <> ''", " ({tag_names}).", choice="tags"),
    Rule("summary", ("issue",), "true", ".", choice="tags"),
    Rule("summary", ("issue",), "true", " Durum: {status_name}."),
    Rule("summary", ("issue",), "product_names <> ''", " Etkilenen: {product_names}."),
    Rule("summary", ("issue",), "source_sentence <> ''", " Kaynak (özgün dil): “{source_sentence}”"),
    Rule("summary", ("release",), "true", "{published_day} tarihinde yayımlandı. Build: {builds_or}. Ürünler: {products_or}."),
    Rule("summary", ("release",), "expired", " Microsoft bu güncellemeyi geri çekti/süresi dolmuş olarak işaretledi."),
    Rule("summary", ("release",), "field_sources > 0", " Bu KB için {field_sources} saha raporu belirti belirtmeden anıyor."),
    Rule("summary", ("feature", "notice"), "week is not null and service is not null", "{stage_name} (hafta: {week}, servis sürümü {service}). {two_sentences}", choice="stage"),
    Rule("summary", ("feature", "notice"), "week is not null", "{stage_name} (hafta: {week}). {two_sentences}", choice="stage"),
    Rule("summary", ("feature", "notice"), "true", "{stage_name}. {two_sentences}", choice="stage"),
    Rule("summary", ("version",), "track <=> 'tp'", "Technical Preview yalnızca laboratuvar ortamı içindir. {one_sentence}", choice="version"),
    Rule("summary", ("version",), "true", "Sürüm {version} (build {build_or}); erişilebilirlik: {available_day}; destek sonu: {support_end_day}.", choice="version"),
    Rule("summary", ("hotfix",), "true", "{hotfix_name}; geçerli sürümler: {versions_or}."),
    Rule("summary", ("hotfix",), "fixed_count > 0", " Düzeltilen {fixed_count} sorundan bazıları: {fixed_first}."),
    Rule("summary", OTHER, "some_sentences <> ''", "{some_sentences}", choice="said"),
    Rule("summary", OTHER, "true", "Özet metni yok.", choice="said"),
    Rule("summary", ("news",), "source_count > 1", " ({source_count} kaynakta yer aldı.)"),
    Rule("summary", ("content",), "is_video and has_transcript", " Transkript kullanıldı.", choice="video"),
    Rule("summary", ("content",), "is_video", " Not: Transkript kullanılamadı; özet yalnızca başlık/açıklamaya dayanıyor.", choice="video"),
    Rule("why", ANY, "own_products <> ''", "Takip ettiğiniz ürünleri etkiliyor: {own_products}."),
    Rule("why", ANY, "own_roles <> ''", "Ortamınızdaki rollerle ilgili: {own_roles}."),
    Rule("why", ANY, "own_configmgr", "Kullandığınızı belirttiğiniz ConfigMgr {own_version} sürümüyle ilgili."),
    Rule("why", ANY, "module = 'intune' and own_platforms <> ''", "Yönettiğiniz Intune platformu: {own_platforms}."),
    Rule("why", ANY, "module = 'intune'", "Özelliğin tenant'ınızda açıldığı doğrulanmadı (dağıtım kademeli olabilir).", choice="none"),
    Rule("why", ANY, "own_products = '' and own_roles = '' and not own_configmgr", "Seçtiğiniz ürün ve rollerle doğrudan eşleşme bulunmadı; genel bilgi olarak listelendi.", choice="none"),
    Rule("actions", ("issue",), "workaround_long <> ''", "Kaynaktaki geçici çözümü inceleyin: {workaround_long}", SOURCE, "{workaround_short}", "workaround"),
    Rule("actions", ("issue",), "kir", "Known Issue Rollback (KIR) yayımlandı; kaynaktaki Grup İlkesi adımlarını izleyin.", SOURCE, "Known Issue Rollback", "workaround"),
    Rule("actions", ("issue",), "resolving_names <> ''", "Düzeltmeyi içeren güncellemeyi ({resolving_names}) test halkanızda değerlendirin.", SOURCE, "{resolving_names}", "fix"),
    Rule("actions", ("issue",), "partial_names <> ''", "{partial_names} sorunu yalnızca kısmen düzeltiyor; kalan belirtiler için kaynaktaki açıklamayı izleyin.", SOURCE, "{partial_names}", "fix"),
    Rule("actions", ("issue",), "evidence <=> 'field'", "Microsoft teyidi yok. Kendi ortamınızda belirtiyi gözlemleyip gözlemlemediğinizi kontrol edin; yaygın dağıtımı pilot grupla sınırlamayı değerlendirin.", RULE),
    Rule("actions", ("release",), "release_type = 'security'", "Aylık güvenlik güncellemesi: standart dağıtım halkalarınızla planlayın; bağlı bilinen sorun kartlarını kontrol edin.", RULE),
    Rule("actions", ("release",), "release_type = 'preview'", "İsteğe bağlı preview: üretim yerine pilot/test grubunda değerlendirilmesi yaygın uygulamadır.", RULE),
    Rule("actions", ("release",), "release_type = 'oob'", "Plan dışı (OOB) güncelleme: KB makalesinde belirtilen sorundan etkileniyorsanız değerlendirin.", RULE),
    Rule("actions", ("release",), "release_type = 'hotpatch'", "Hotpatch güvenlik güncellemesi: hotpatch kayıtlı cihazlarınız için geçerlidir.", RULE),
    Rule("actions", ("feature", "notice"), "admin_long <> ''", "Hazırlık adımı (kaynak): {admin_long}", SOURCE, "{admin_short}"),
    Rule("actions", ("feature", "notice"), "licence_long <> ''", "Lisans/ön koşul notu (kaynak): {licence_long}", SOURCE, "{licence_short}"),
    Rule("actions", ("version",), "not (track <=> 'tp') and own_version <=> version and days_left <= 90", "Desteklenen daha yeni bir Current Branch sürümüne yükseltmeyi planlayın.", RULE),
]


def _filled(template: str) -> Column:
    """The template with its columns, null as nothing."""
    parts, rest = [], template
    while rest:
        before, mark, rest = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if mark:
            name, _, rest = rest.partition("}")
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _is_of(kinds: tuple[str, ...]) -> Column:
    if kinds == ANY:
        return F.lit(True)
    if kinds == OTHER:
        return ~F.coalesce(F.col("kind").isin([k for k in ANY if k not in OTHER]), F.lit(False))
    return F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False))


def written(field: str, rules: list[Rule] | None = None) -> Column:
    """array of structs (text, basis, evidence_quote) that the rules of a field write, in their order."""
    out = []
    for choice, group in groupby((r for r in rules or RULES if r.field == field), key=lambda r: r.choice or id(r)):
        told: Column | None = None
        for r in group:
            holds = _is_of(r.kinds) & F.coalesce(F.expr(r.when), F.lit(False))
            row = F.struct(_filled(r.template).alias("text"), F.lit(r.basis).alias("basis"), _filled(r.quote).alias("evidence_quote"))
            told = F.when(holds, row) if told is None else told.when(holds, row)
        out.append(told)
    return F.array_compact(F.array(*out))


def _names(table: dict[str, str], values: Column, sep: str = ", ", known: bool = False) -> Column:
    """The names of values, joined; unknown ones as they are, or left out."""
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    each = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.try_element_at(names, v) if known else F.coalesce(F.try_element_at(names, v), v))
    return F.array_join(F.array_compact(each), sep)


def _name(table: dict[str, str], value: Column, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value), otherwise)


def without_status_lines(c: Column) -> Column:
    """The text without the lines that only repeat its state, as one line."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(fixed.STATUS_LINE)), " ")


#: The columns that events may have; what is not there is null.
COLUMNS = {
    "title": "string", "module": "string", "evidence": "string", "status": "string", "products": "array<string>", "tags": "array<string>", "versions": "array<string>", "platforms": "array<string>", "originating_kbs": "array<string>",
    "resolving_kbs": "array<string>", "partial_fix_kbs": "array<string>", "kir": "boolean", "workaround_text": "string", "main_text": "string", "main_summary": "string", "kb": "string", "release_type": "string", "published_at": "timestamp",
    "builds": "array<string>", "expired": "boolean", "field_sources": "long", "stage": "string", "week": "string", "service": "string", "admin_text": "string", "licence_note": "string", "version": "string", "track": "string", "build": "string",
    "days_left": "long", "available_at": "timestamp", "support_end": "timestamp", "hotfix_type": "string", "fixed_issues": "array<string>", "source_count": "long", "is_video": "boolean", "has_transcript": "boolean",
}


def prepared(events: DataFrame, profile, zone: str = "Europe/Istanbul") -> DataFrame:
    """event, kind and the columns that conditions and templates name."""
    rows = events.select("event", "kind", *((F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))
    c, none = F.col, F.array().cast("array<string>")
    lits = lambda values: F.array(*map(F.lit, values)) if values else none
    kbs = lambda name: F.array_join(F.transform(F.coalesce(name, none), lambda k: F.concat(F.lit("KB"), k)), ", ")
    some = lambda value: F.coalesce(F.nullif(value, F.lit("")), F.lit("?"))
    own = lambda name, values: F.filter(F.coalesce(name, none), lambda x: F.array_contains(lits(values), x))
    tags = F.filter(F.coalesce("tags", none), lambda t: F.array_contains(lits(list(fixed.TAG_NAMES)), t))
    roles = [F.when(F.arrays_overlap(F.coalesce("tags", none), lits(fixed.ROLE_TAGS.get(r, []))), F.lit(fixed.ROLE_NAMES.get(r, r))) for r in profile.roles]
    version = F.lit(profile.version).cast("string")
    plain = F.coalesce("main_text", F.lit(""))
    said = F.coalesce(F.nullif("main_summary", F.lit("")), plain)
    fixed_issues = F.coalesce("fixed_issues", none)
    cut = lambda name, n: text.truncate(F.coalesce(c(name), F.lit("")), n)
    return rows.withColumns({
        "own_title": F.coalesce("title", F.lit("")), "origin_names": kbs("originating_kbs"), "resolving_names": kbs("resolving_kbs"), "partial_names": kbs("partial_fix_kbs"), "tag_names": _names(fixed.TAG_NAMES, F.slice(tags, 1, 3), known=True),
        "status_name": _name(fixed.STATUS_NAMES, c("status"), F.lit("?")), "product_names": _names(fixed.PRODUCT_NAMES, c("products")), "products_or": some(_names(fixed.PRODUCT_NAMES, c("products"))),
        "source_sentence": text.first_sentences(without_status_lines(plain), 1, 260), "one_sentence": text.first_sentences(plain, 1, 240), "two_sentences": text.first_sentences(said, 2, 360), "some_sentences": text.first_sentences(said, 2, 380),
        "workaround_long": cut("workaround_text", 260), "workaround_short": cut("workaround_text", 200), "admin_long": cut("admin_text", 260), "admin_short": cut("admin_text", 200), "licence_long": cut("licence_note", 220), "licence_short": cut("licence_note", 200),
        "release_name": _name(fixed.RELEASE_NAMES, c("release_type"), F.lit("Güncelleme")), "published_day": dates.long_label(c("published_at"), False, zone), "builds_or": some(F.array_join(F.coalesce("builds", none), ", ")), "stage_name": _name(fixed.STAGE_NAMES, c("stage"), F.coalesce("stage", F.lit(""))),
        "build_or": some(c("build")), "available_day": dates.long_label(c("available_at"), False, zone), "support_end_day": dates.long_label(c("support_end"), False, zone), "hotfix_name": _name(fixed.HOTFIX_NAMES, c("hotfix_type"), F.lit("Hotfix")), "versions_or": some(F.array_join(F.coalesce("versions", none), ", ")),
        "fixed_count": F.size(fixed_issues), "fixed_first": F.array_join(F.transform(F.slice(fixed_issues, 1, 3), lambda x: text.truncate(x, 90)), "; "),
        "own_products": _names(fixed.PRODUCT_NAMES, own("products", profile.products)), "own_roles": F.array_join(F.array_compact(F.array(*roles)), ", ") if roles else F.lit(""), "own_version": version, "own_platforms": _names(fixed.PLATFORM_NAMES, own("platforms", profile.platforms)),
        "own_configmgr": F.coalesce((c("module") == "configmgr") & version.isNotNull() & (c("version").eqNullSafe(version) | F.coalesce(F.array_contains("versions", version), F.lit(False))), F.lit(False)),
    })


def summaries(events: DataFrame, profile, zone: str = "Europe/Istanbul") -> DataFrame:
    """event, title, summary, why and actions (text, basis, evidence_quote) of events, for a reader's profile.

    events: event, kind and what they have of COLUMNS. A kind that is not heard of is told like news.
    """
    rows = prepared(events, profile, zone)
    rows = rows.select("event", *(written(f).alias(f) for f in ("title", "summary", "why", "actions")))
    joined = lambda f, sep: F.array_join(F.col(f)["text"], sep)
    return rows.select("event", text.truncate(joined("title", ""), TITLE_CHARS).alias("title"), text.truncate(joined("summary", ""), SUMMARY_CHARS).alias("summary"), joined("why", " ").alias("why"), "actions")
