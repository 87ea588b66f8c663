"""Event details and summaries by rule as queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.functions import dates, urls
from dawnline.operators import detail, summaries
from dawnline.operators.fusion import Profile
from dawnline.plans.tables import Registry, table
from dawnline.workspace import stored

R = Registry()


@R.query("""with l as (select l_orderkey as event, (cast(l_linenumber as bigint)*100000000+l_partkey*1000+l_suppkey%1000)*100000+date_diff('day', date '1990-01-01', l_shipdate::date) as n, l_linenumber as ln, l_shipdate as "at", l_suppkey as s, l_quantity as q, l_returnflag as f from lineitem),
v as (select event, 'version' as part, row_number() over (partition by event order by n desc) as place, n as id, "at", 'v'||ln as label, null::bigint as count from l),
e as (select event, 'evidence' as part, row_number() over (partition by event order by "at", n) as place, n as id, "at", case when s%3=0 then case when f='R' then 'official' else 'community' end when f='R' then 'press' else 'community' end||': s'||s as label, cast(trunc(q) as bigint)%4 as count from l),
d as (select event, n*100+i as id, "at" + to_hours(i::int) as "at", 'd'||i as label from (select *, unnest(range(1, cast(trunc(q) as bigint)//8+1)) as i from l)),
a as (select event, n*100+i as id, "at" + to_hours(i::int) as "at", 'a'||i as label from (select *, unnest(range(1, s%5+1)) as i from l)),
x as (select event, 'delivery' as part, row_number() over (partition by event order by id desc) as place, id, "at", label, null::bigint as count from d), y as (select event, 'action' as part, row_number() over (partition by event order by id desc) as place, id, "at", label, null::bigint as count from a)
select * from v union all select * from e union all select * from x where place<=20 union all select * from y where place<=20""")
def k8_event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: their lines are versions and evidence, with snapshots, deliveries and actions by their amounts."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("event"), ((c("l_linenumber").cast("long") * 100000000 + c("l_partkey") * 1000 + c("l_suppkey") % 1000) * 100000 + F.date_diff("l_shipdate", F.lit("1990-01-01"))).alias("id"), c("l_linenumber").alias("n"), c("l_shipdate").alias("at"), c("l_suppkey").alias("s"), F.floor("l_quantity").cast("long").alias("q"), c("l_returnflag").alias("f"))
    many = lambda n, label: lines.withColumn("i", F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))).select("event", (c("id") * 100 + c("i")).alias("id"), (c("at") + F.make_dt_interval(hours=c("i").cast("int"))).alias("at"), F.concat(F.lit(label), c("i").cast("string")).alias("label"))
    source = F.when(c("f") == "R", F.when(c("s") % 3 == 0, "official").otherwise("press")).otherwise("community")
    histories = {
        "versions": lines.select("event", "id", "at", F.concat(F.lit("v"), c("n").cast("string")).alias("label")), "evidence": lines.select("event", "id", "at", F.concat(F.lit("s"), c("s").cast("string")).alias("label"), F.lit("https://example.org/x").alias("url"), source.alias("source")),
        "snapshots": many(c("q") % 4, "x").select("event", F.floor(c("id") / 100).alias("id"), "at"), "deliveries": many(F.floor(c("q") / 8), "d"), "actions": many((c("s") % 5).cast("long"), "a"),
    }
    names = detail.write_histories(histories, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the source's trust as its links allow it
    with detail.by_event_alone(spark):
        out = stored(spark, detail.event_details(spark, names, F.coalesce(urls.effective_trust(c("source"), c("url")), c("source"))), "details")
    detail.drop_histories(spark, names)
    return out


def _pick(values: list, n: Column) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


_MONTHS = "['Ocak','Şubat','Mart','Nisan','Mayıs','Haziran','Temmuz','Ağustos','Eylül','Ekim','Kasım','Aralık']"
_WORDS = {"confirmed": "Doğrulandı (açık)", "resolved": "Çözüldü"}


@R.query(f"""with d as (select doc_id as n, doc_id//6 as m, ['issue','release','feature','version','hotfix','news'][doc_id%6+1] as kind from documents),
f as (select n, m, kind, 'T'||n as own, 'It stops at '||n||'.' as one, 'Status: x It stops at '||n||'. Then more.' as two, m%2=0 as known, m//2%4 as t,
  [null, -3, 30, 200][m//2%4+1] as days, day(date '2024-01-15' + cast(m%400 as int))||' '||{_MONTHS}[month(date '2024-01-15' + cast(m%400 as int))]||' '||year(date '2024-01-15' + cast(m%400 as int)) as dated from d),
s as (select *, case kind when 'release' then 'KB'||(5100000+m)||' — '||['Aylık güvenlik güncellemesi','Preview (isteğe bağlı, güvenlik dışı)','OOB (plan dışı)','Hotpatch güvenlik güncellemesi','Diğer güncelleme','Güncelleme'][m%6+1]
    when 'version' then case when known then own when days<0 then 'ConfigMgr '||case when m%4=3 then '2403' else '2409' end||': destek sona erdi' when days is not null then 'ConfigMgr '||case when m%4=3 then '2403' else '2409' end||': destek bitişine '||days||' gün' else 'ConfigMgr '||case when m%4=3 then '2403' else '2409' end||': sürüm bilgisi' end else own end as title,
  case kind when 'issue' then case when m%3=0 then 'Bildirilen sorun' else 'KB'||(5000000+m%97)||' sonrasında bildirilen sorun' end||[' (Uzak Masaüstü (RDS/RDP), Kimlik doğrulama, VPN).',' (Performans).','.','.'][m%4+1]||' Durum: '||['Doğrulandı (açık)','Çözüldü','?'][m%3+1]||'.'||case when known then ' Etkilenen: Windows Server 2025, other.' else '' end||' Kaynak (özgün dil): “'||one||'”'
    when 'release' then dated||' tarihinde yayımlandı. Build: '||case when m%3=0 then '?' else '26100.1, 20348.2' end||'. Ürünler: '||case when known then 'Windows Server 2025, other' else '?' end||'.'||case when m%4=0 then ' Microsoft bu güncellemeyi geri çekti/süresi dolmuş olarak işaretledi.' else '' end||case when m%3>0 then ' Bu KB için '||(m%3)||' saha raporu belirti belirtmeden anıyor.' else '' end
    when 'feature' then ['Genel kullanıma açıldı','Public preview','x'][m%3+1]||case when known then ' (hafta: May 6, 2024'||case when m%4=0 then ', servis sürümü 2405' else '' end||')' else '' end||'. '||two
    when 'version' then case when known then 'Technical Preview yalnızca laboratuvar ortamı içindir. Status: x '||one else 'Sürüm '||case when m%4=3 then '2403' else '2409' end||' (build '||case when m%3=0 then '?' else '5.00' end||'); erişilebilirlik: '||dated||'; destek sonu: —.' end
    when 'hotfix' then case when known then 'Güvenlik güncellemesi' else 'Hotfix' end||'; geçerli sürümler: '||case when m%3=0 then '?' else '2403, 2409' end||'.'||case when known then ' Düzeltilen 4 sorundan bazıları: One.; Two.; Three..' else '' end
    else case when m%5=0 then 'Özet metni yok.' else 'Said so. Twice.' end||case when m%4>1 then ' ('||(m%4)||' kaynakta yer aldı.)' else '' end end as summary,
  list_filter([case when known and kind<>'feature' then 'Takip ettiğiniz ürünleri etkiliyor: Windows Server 2025.' end, case when kind='issue' and m%4=0 then 'Ortamınızdaki rollerle ilgili: Uzak Masaüstü Hizmetleri (RDS/RDP).' end,
    case when kind='version' and m%4=3 or kind='hotfix' and m%3<>0 then 'Kullandığınızı belirttiğiniz ConfigMgr 2403 sürümüyle ilgili.' end, case when kind='feature' and known then 'Yönettiğiniz Intune platformu: iOS/iPadOS.' end, case when kind='feature' then 'Özelliğin tenant''ınızda açıldığı doğrulanmadı (dağıtım kademeli olabilir).' end], lambda x: x is not null) as hits,
  list_filter(case kind when 'issue' then [case when m%5=0 then 'kaynak|Kaynaktaki geçici çözümü inceleyin: Restart it.|Restart it.' when m%5=1 then 'kaynak|Known Issue Rollback (KIR) yayımlandı; kaynaktaki Grup İlkesi adımlarını izleyin.|Known Issue Rollback' end,
      case when m%4=1 then 'kaynak|Düzeltmeyi içeren güncellemeyi (KB6000001, KB6000002) test halkanızda değerlendirin.|KB6000001, KB6000002' when m%4=2 then 'kaynak|KB6000003 sorunu yalnızca kısmen düzeltiyor; kalan belirtiler için kaynaktaki açıklamayı izleyin.|KB6000003' end,
      case when m%3=0 then 'kural|Microsoft teyidi yok. Kendi ortamınızda belirtiyi gözlemleyip gözlemlemediğinizi kontrol edin; yaygın dağıtımı pilot grupla sınırlamayı değerlendirin.|' end]
    when 'release' then ['kural|'||['Aylık güvenlik güncellemesi: standart dağıtım halkalarınızla planlayın; bağlı bilinen sorun kartlarını kontrol edin.','İsteğe bağlı preview: üretim yerine pilot/test grubunda değerlendirilmesi yaygın uygulamadır.','Plan dışı (OOB) güncelleme: KB makalesinde belirtilen sorundan etkileniyorsanız değerlendirin.','Hotpatch güvenlik güncellemesi: hotpatch kayıtlı cihazlarınız için geçerlidir.',null,null][m%6+1]||'|']
    when 'feature' then [case when m%3=0 then 'kaynak|Hazırlık adımı (kaynak): Plan it.|Plan it.' end, case when m%5=0 then 'kaynak|Lisans/ön koşul notu (kaynak): E5 only.|E5 only.' end]
    when 'version' then [case when not known and m%4=3 and days<=90 then 'kural|Desteklenen daha yeni bir Current Branch sürümüne yükseltmeyi planlayın.|' end] else []::varchar[] end, lambda x: x is not null) as actions from f)
select n as doc_id, title, summary, case when len(hits)=0 then 'Seçtiğiniz ürün ve rollerle doğrudan eşleşme bulunmadı; genel bilgi olarak listelendi.' else array_to_string(hits, ' ') end as why, actions from s""")
def p16_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their numbers as events of six kinds, told to one reader."""
    n, m = F.col("doc_id"), F.floor(F.col("doc_id") / 6)
    kind, none = _pick(["issue", "release", "feature", "version", "hotfix", "news"], n), F.array().cast("array<string>")
    one = lambda *values: F.array(*map(F.lit, values))
    number = lambda base, k: (F.lit(base) + k).cast("string")
    when = lambda condition, value: F.when(condition, value)
    day = F.date_add(F.lit("2024-01-15").cast("date"), (m % 400).cast("int")).cast("timestamp")
    events = table(spark, sf_dir, "documents").select(
        n.alias("event"), kind.alias("kind"), F.concat(F.lit("T"), n.cast("string")).alias("title"), F.when(kind == "feature", "intune").when(kind.isin("version", "hotfix"), "configmgr").otherwise("windows").alias("module"),
        when(m % 3 != 0, F.array(number(5000000, m % 97))).alias("originating_kbs"), F.when(kind == "issue", _pick([one("rds", "auth", "vpn", "audio"), one("performance"), one("nonsense"), none], m)).alias("tags"), _pick(["confirmed", "resolved", "odd"], m).alias("status"),
        F.when((m % 2 == 0) & (kind != "feature"), one("ws2025", "other")).otherwise(none).alias("products"), F.when((kind == "news") & (m % 5 == 0), "").when(kind == "news", "Said so. Twice. Thrice.").otherwise(F.concat(F.lit("Status: x\nIt stops at "), n.cast("string"), F.lit(". Then more."))).alias("main_text"),
        when(m % 5 == 0, "Restart it.").alias("workaround_text"), (m % 5 == 1).alias("kir"), when(m % 4 == 1, one("6000001", "6000002")).alias("resolving_kbs"), when(m % 4 == 2, one("6000003")).alias("partial_fix_kbs"), F.when(m % 3 == 0, "field").otherwise("ms_official").alias("evidence"),
        number(5100000, m).alias("kb"), _pick(["security", "preview", "oob", "hotpatch", "other", "odd"], m).alias("release_type"), day.alias("published_at"), day.alias("available_at"), when(m % 3 != 0, one("26100.1", "20348.2")).alias("builds"), (m % 4 == 0).alias("expired"), (m % 3).alias("field_sources"),
        _pick(["ga", "public_preview", "x"], m).alias("stage"), when(m % 2 == 0, "May 6, 2024").alias("week"), when(m % 4 == 0, "2405").alias("service"), when(m % 3 == 0, "Plan it.").alias("admin_text"), when(m % 5 == 0, "E5 only.").alias("licence_note"),
        F.when(m % 2 == 0, one("ios", "linux")).otherwise(one("macos")).alias("platforms"), F.when(m % 2 == 0, "tp").otherwise("cb").alias("track"), F.when(kind == "version", F.when(m % 4 == 3, "2403").otherwise("2409")).alias("version"), _pick([F.lit(None).cast("long"), F.lit(-3).cast("long"), F.lit(30).cast("long"), F.lit(200).cast("long")], F.floor(m / 2)).alias("days_left"),
        when(m % 3 != 0, "5.00").alias("build"), F.when(m % 2 == 0, "security").otherwise("odd").alias("hotfix_type"), when((m % 3 != 0) & (kind == "hotfix"), one("2403", "2409")).alias("versions"), when(m % 2 == 0, one("One.", "Two.", "Three.", "Four.")).alias("fixed_issues"), (m % 4).alias("source_count"),
    )
    reader = Profile(products=["ws2025"], roles=["rds", "dc"], version="2403", platforms=["ios"])
    told = F.transform("actions", lambda a: F.concat_ws("|", a["basis"], a["text"], a["evidence_quote"]))
    return summaries.summaries(events, reader, "UTC").select(F.col("event").alias("doc_id"), "title", "summary", "why", told.alias("actions"))


@R.query(f"""select event_id, day(ts)||' '||{_MONTHS}[month(ts)]||' '||year(ts)||' '||strftime(ts, '%H:%M') as label, day(ts)||' '||{_MONTHS}[month(ts)]||' '||year(ts)||', '||['Pazartesi','Salı','Çarşamba','Perşembe','Cuma','Cumartesi','Pazar'][isodow(ts)] as day from events""")
def d4_long_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", dates.long_label(ts, zone="UTC").alias("label"), dates.day_label(F.to_date("ts")).alias("day"))
