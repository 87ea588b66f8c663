"""Word lists, patterns and catalogues that results depend on."""

from __future__ import annotations

#: English and Turkish stop words, folded.
STOPWORDS = """
a an the and or of to in on for with without after before during is are was were be been being
might may can could will would should some any all this that these those it its as at by from
into about over under than then when where which who whom what how not no yes via per also
more most less new now still only other such there their they them we you your our
ve ile bir bu su da de ki icin gibi daha cok en ne mi mu olarak olan sonra once gore kadar ama
fakat veya ya hem her tum bazi yeni son dedi oldu etti ise ile uzerine hakkinda icinde
""".split()

#: Words that every technical record has.
DOMAIN_NOISE = """
windows microsoft update updates updated updating install installed installing installation
device devices user users experience experiencing issue issues problem problems known
affected affect affects might occur occurs security preview release released version versions
build builds kb os client server servers system systems customers organizations environment
environments sorun sorunu sorunlar guncelleme guncellemesi guncellemeler cihaz cihazlar kullanici
kullanicilar sistem hata yuklendikten yukledikten sonrasinda bazi
""".split()

#: Product, family, build numbers.
PRODUCTS = [
    ("win11-26h1", "client", ["28000"]),
    ("win11-25h2", "client", ["26200"]),
    ("win11-24h2", "client", ["26100"]),
    ("win11-23h2", "client", ["22631", "22621"]),
    ("win10-22h2", "client", ["19045"]),
    ("win10-ltsc2021", "client", ["19044"]),
    ("ws2025", "server", ["26100"]),
    ("ws2022", "server", ["20348"]),
    ("ws23h2", "server", ["25398"]),
    ("ws2019", "server", ["17763"]),
    ("ws2016", "server", ["14393"]),
]

#: Pattern (case-insensitive), product.
PRODUCT_PATTERNS = [
    (r"windows 11,?\s*(?:version\s*|sürüm\s*)?26h1", "win11-26h1"),
    (r"windows 11,?\s*(?:version\s*|sürüm\s*)?25h2", "win11-25h2"),
    (r"windows 11,?\s*(?:version\s*|sürüm\s*)?24h2", "win11-24h2"),
    (r"windows 11,?\s*(?:version\s*|sürüm\s*)?(?:23h2|22h2)", "win11-23h2"),
    (r"windows 10,?\s*(?:version\s*|sürüm\s*)?22h2", "win10-22h2"),
    (r"windows 10 enterprise ltsc 2021|windows 10,?\s*(?:version\s*)?21h2", "win10-ltsc2021"),
    (r"windows server 2025", "ws2025"),
    (r"windows server 2022", "ws2022"),
    (r"windows server,?\s*(?:version\s*)?23h2", "ws23h2"),
    (r"windows server 2019|windows 10,?\s*(?:version\s*)?1809", "ws2019"),
    (r"windows server 2016|windows 10,?\s*(?:version\s*)?1607", "ws2016"),
    (r"microsoft server operating system,?\s*(?:version\s*)?24h2", "ws2025"),
]

#: Symptom tag, its keys in English and Turkish, folded; a space belongs to its key.
SYMPTOM_TAGS = {
    "rds": ["remote desktop", "rdp", "rds ", "rd gateway", "remoteapp", "session host", "terminal server", "uzak masaustu", "remote desktop services"],
    "dc": ["domain controller", "active directory", "ad ds", "lsass", "etki alani denetleyicisi", "domain controllers", "dcpromo", "netlogon"],
    "auth": ["kerberos", "ntlm", "authentication", "sign in", "sign-in", "signin", "logon", "log on", "credential guard", "secure channel", "smart card", "windows hello", "kimlik dogrulama", "oturum ac", "giris yapam", "credentials", "password"],
    "vpn": ["vpn", "always on vpn", "rras", "l2tp", "ikev2", "sstp", "directaccess"],
    "bitlocker": ["bitlocker", "recovery key", "kurtarma anahtar", "recovery screen"],
    "boot": ["boot", "startup", "start up", "fails to start", "blue screen", "bsod", "bugcheck", "stop error", "restart loop", "boot loop", "secure boot", "uefi", "acilis", "mavi ekran", "baslatilamiyor", "inaccessible_boot_device", "winre", "recovery environment", "desktop loading", "black screen"],
    "network": ["network", "networking", "wi-fi", "wifi", "ethernet", "dns", "dhcp", "smb", "tcp/ip", "internet connection", "wlan", "802.1x", "network adapter", "ag baglanti", "internet baglanti", "firewall", "proxy"],
    "update_install": ["fails to install", "failed to install", "install fail", "0x800f", "0x8007", "installation failure", "update rolls back", "rolled back", "undoing changes", "yuklenemiyor", "kurulum basarisiz", "wsus", "windows update fails"],
    "printing": ["printer", "printing", "print spooler", "spooler", "yazici"],
    "hyperv": ["hyper-v", "virtual machine", "failover cluster", "cluster", "live migration", "vm "],
    "avd": ["azure virtual desktop", "fslogix", "avd", "windows 365", "cloud pc"],
    "performance": ["performance", "slow", "high cpu", "memory leak", "freeze", "hang", "unresponsive", "yavas", "donma", "takil"],
    "audio": ["audio", "sound", "speaker", "microphone", "ses "],
    "backup": ["file history", "backup", "back up", "backing up", "yedekleme", "yedek al"],
    "display": ["display driver", "external display", "external monitor", "multiple monitors", "graphics driver", "gpu", "screen flicker", "flickering"],
    "storage": ["disk", "storage", "file system", "ntfs", "refs", "file share", "host folder"],
    "shell": ["file explorer", "explorer.exe", "windows explorer", "start menu", "taskbar", "desktop background", "dosya gezgini", "baslat menusu", "gorev cubugu"],
    "security": ["zero-day", "zero day", "exploited", "actively exploited", "security feature bypass", "sifir gun", "istismar"],
    "configmgr": ["configmgr", "configuration manager", "sccm", "mecm", "software center", "ccmsetup", "task sequence", "management point", "distribution point"],
    "intune": ["intune", "mdm enrollment", "company portal", "autopilot", "compliance policy"],
    "gpo": ["group policy", "gpo", "grup ilkesi"],
    "iis": ["iis ", "internet information services"],
    "adcs": ["certificate services", "ad cs", "certificate authority", "pki"],
    "apps": ["outlook", "office", "teams", "edge", "app crash", "application crash", "uygulama cok"],
}

#: Sets of tags, and the tags of each role.
HIGH_IMPACT_TAGS = ["rds", "dc", "auth", "vpn", "bitlocker", "network", "boot"]
BROAD_TAGS = ["auth", "network", "storage"]
WEAK_TAGS = ["update_install", "performance", "apps", "security"]
ROLE_TAGS = {
    "dc": ["dc"],
    "rds": ["rds"],
    "hyperv": ["hyperv"],
    "wsus": ["update_install"],
    "print": ["printing"],
    "vpn": ["vpn"],
    "iis": ["iis"],
    "fileserver": ["storage", "network"],
    "adcs": ["adcs"],
    "avd": ["avd", "rds"],
    "bitlocker": ["bitlocker"],
    "autopilot": ["intune"],
    "comanagement": ["configmgr", "intune"],
}

#: Words of issue reports (English, then Turkish, folded) and of the tracked scope.
ISSUE_WORDS = [
    "issue", "bug", "broke", "broken", "breaks", "fail", "fails", "failing", "failure", "error", "crash", "crashes", "problem", "not working", "stopped working", "can't", "cannot", "unable", "bsod", "blue screen", "boot loop", "regression", "workaround", "pulled", "known issue",
    "sorun", "hata", "cokme", "coktu", "calismiyor", "bozuldu", "acilmiyor", "basarisiz", "mavi ekran", "gecici cozum",
]
SCOPE_WORDS = ["windows", "server 20", "intune", "configmgr", "configuration manager", "sccm", "mecm", "autopilot", "patch tuesday", "cumulative update", " kb5", " kb4"]

#: Partial fixes, negated statements, the standard warning about the registry.
PARTIAL_FIX = r"(?i)\bpartial(?:ly)?\b|\binitial (?:solution|fix)\b|\bresolved some\b"
NEGATED = r"(?i)\b(?:does not|doesn't|do not|don't|is not|isn't|are not|aren't|will not|won't|not)\s+(?:\w+\s+){0,2}(?:affect|affected|impact|impacted|apply|applies|occur)\b|etkilemez|etkilenmez"
NEGATED_STEMS = ["affect", "impact", "appl", "occur", "etkilemez", "etkilenmez"]  # one of which every negated sentence holds
REGISTRY_WARNING = r"(?is)Important:\s*This section[^.]*modifying the registry\..*?(?:how to back up and restore the registry[^.\n]*\.?|$)"

#: Patterns of community and official pages, official blog boards, press domains.
COMMUNITY_PAGES = [
    r"(?i)^https?://(?:[a-z-]+\.)?learn\.microsoft\.com/[^/]+/answers/",
    r"(?i)^https?://answers\.microsoft\.com/",
    r"(?i)^https?://social\.(?:technet|msdn)\.microsoft\.com/",
    r"(?i)^https?://techcommunity\.microsoft\.com/(?:discussions|t5/[^/]+/(?:[^/]+/)?(?:m-p|td-p|qaq-p)/)",
    r"(?i)^https?://feedbackportal\.microsoft\.com/",
    r"(?i)^https?://github\.com/",
    r"(?i)^https?://(?:www\.|old\.)?reddit\.com/",
]
BLOG_PAGE = r"(?i)^https?://techcommunity\.microsoft\.com/(?:blog|category/[^/]+/blog|t5/[^/]+/bg-p|t5/([^/]+)/ba-p)/?([^/?#]*)"
OFFICIAL_PAGES = [
    r"(?i)^https?://learn\.microsoft\.com/(?!.*/answers/)(?!.*/archive/)",
    r"(?i)^https?://support\.microsoft\.com/",
    r"(?i)^https?://msrc\.microsoft\.com/",
    r"(?i)^https?://blogs\.windows\.com/",
    r"(?i)^https?://www\.microsoft\.com/[^/]+/security/blog/",
]
OFFICIAL_BOARDS = ["intunecustomersuccess", "windows-itpro-blog", "windowsitpro", "configurationmanagerblog", "windowsservernewsandbestpractices", "microsoftintuneblog", "windows-servicing", "msrc", "coreinfrastructureandsecurityblog", "askds", "networkingblog", "itopstalkblog"]
PRESS_DOMAINS = ["bleepingcomputer.com", "borncity.com", "windowslatest.com", "theregister.com", "neowin.net", "windowscentral.com", "askwoody.com", "theverge.com", "arstechnica.com", "zdnet.com", "computerworld.com", "petri.com", "windowsforum.com", "securityweek.com", "helpnetsecurity.com", "techradar.com", "webrazzi.com", "shiftdelete.net", "donanimhaber.com", "chip.com.tr"]
SECOND_LEVELS = ["co", "com", "org", "net", "gov", "ac"]

#: Orders from weakest to strongest, resolved states, month and day names.
RISKS = ["low", "medium", "high", "critical"]
EVIDENCES = ["field", "ms_official", "ms_known_issue"]
RESOLVED = ["resolved", "resolved_external"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MITIGATED = ["mitigated", "mitigated_external"]

#: How much a tag counts for the risk of an issue, by the first group that it is in; any other tag, no tag;
#: what a server product adds, what a resolved state and a mitigated one or a workaround take away; levels from a sum up.
TAG_IMPACTS = [
    (["security"], 3.5),
    (["dc", "auth", "boot", "bitlocker"], 3.0),
    (["rds", "vpn", "network", "hyperv", "avd"], 2.75),
    (["update_install", "printing", "storage", "adcs", "gpo", "configmgr", "intune", "iis"], 2.0),
]
OTHER_TAG_IMPACT, NO_TAG_IMPACT, SERVER_IMPACT, RESOLVED_RELIEF, MITIGATED_RELIEF = 1.5, 1.25, 0.25, 1.5, 0.25
RISK_FROM = [(3.25, "critical"), (2.5, "high"), (1.75, "medium")]

#: The risk of other kinds of events by a field of theirs; all else is low.
RELEASE_RISKS = {"oob": "high", "security": "medium", "hotpatch": "medium"}
SUPPORT_RISKS = {"ended": "high", "<=7": "high", "<=30": "high", "<=90": "medium"}
HOTFIX_RISKS = {"security": "high", "rollup": "medium", "hotfix": "medium"}

#: The names under which a market payload may hold an item, the first one present wins; the last is its label, too.
MARKET_NAMES = {
    "USDTRY": ["USD", "usd", "ABD DOLARI"],
    "EURTRY": ["EUR", "eur", "EURO"],
    "GRAM24": ["gram-altin", "GRA", "gram_altin", "Gram Altın"],
    "BILEZIK22": ["22-ayar-bilezik", "YIA", "22_ayar_bilezik", "22 Ayar Bilezik"],
}
RATE_ITEMS = {"USD": "USDTRY", "EUR": "EURTRY"}

#: What weather codes mean, and what any other code is called.
WEATHER = {
    0: "Açık", 1: "Çoğunlukla açık", 2: "Parçalı bulutlu", 3: "Kapalı", 45: "Sisli", 48: "Kırağılı sis", 51: "Hafif çisenti", 53: "Çisenti", 55: "Yoğun çisenti", 56: "Donan çisenti",
    57: "Yoğun donan çisenti", 61: "Hafif yağmur", 63: "Yağmur", 65: "Kuvvetli yağmur", 66: "Donan yağmur", 67: "Kuvvetli donan yağmur", 71: "Hafif kar", 73: "Kar", 75: "Yoğun kar", 77: "Kar taneleri",
    80: "Hafif sağanak", 81: "Sağanak", 82: "Şiddetli sağanak", 85: "Kar sağanağı", 86: "Yoğun kar sağanağı", 95: "Gök gürültülü fırtına", 96: "Dolu ile fırtına", 99: "Şiddetli dolu ile fırtına",
}
WEATHER_UNKNOWN = "Bilinmiyor"

#: How a text names the publication that it follows; the name comes after.
ATTRIBUTION = r"(?i)(?:via|according to|reported by|kaynak:?)\s+\S*"

#: Patterns of the lines and parts of pages. The groups of a release line: date, hotpatch, KB, builds, the rest.
RELEASE_LINE = r"(?i)([A-Z][a-z]+\.? \d{1,2},? \d{4})\s*[—–-]+\s*(Hotpatch\s+)?KB\s?(\d{6,8})\s*(?:[^()—–]{0,80}?\s*)?\((OS Builds?[^)]*)\)\s*([^|]*)"
FIXED_ISSUE = r"(?m)^\s*-\s+\*\*(.+?)\*\*"
PREVIEW_VERSION = r"(?i)^Technical preview version (\d{4})"
CONTENTS_NAME = r"^\s*-\s*name:\s*(.+)$"
CONTENTS_LINK = r"^\s*href:\s*\S+\.md\s*$"
CONTENTS_VERSION = r"(?i)^Version\s+(\d{4})"
WEEK = r"(?i)Week of ([A-Z][a-z]+ \d{1,2}, \d{4})(?:\s*\(Service release (\d{4})\))?"
APPLIES_TO_VERSIONS = r"(?i)Applies to:?\s*versions?\s*([\d,\sand]+)"
#: Of status pages: anchors of issues, the labels at which a labelled part ends, what the state, its rollback and its dates look like.
ISSUE_ANCHOR = r"(?i)(\d{3,9})msgdesc"
PART_LABELS = ["Workaround", "Resolution", "Next steps", "Affected platforms", "Status", "Originating update", "History", "Back to top", "Note", "Important"]
AFTER_SYMPTOMS = r"(?i)(?<![A-Za-z])(?:Workaround|Resolution|Affected platforms?|Next steps)\s*:"
STATED = r"\b(Resolved External|Resolved(?: KB\d+)?|Mitigated External|Mitigated|Confirmed|Investigating)\b"
ROLLBACK = r"(?i)known issue rollback|\bKIR\b"
HISTORY_DATE = r"\s*:?\s*(\d{4}-\d{2}-\d{2}(?:,?\s*\d{1,2}:\d{2}\s*(?:PT|UTC)?)?|[A-Z][a-z]+ \d{1,2}, \d{4})"
HISTORY_LABELS = {"opened": "Opened", "resolved": "Resolved", "last_updated": "Last updated", "mitigated": "Mitigated"}
#: Of articles: what says that there is no issue, the labels of an issue's parts, what says that it is wholly fixed.
NO_ISSUES = r"(?i)not currently aware of any issues|no known issues"
PART_OF = {
    "symptom": "symptoms", "symptoms": "symptoms", "cause": "symptoms", "workaround": "workaround", "workarounds": "workaround", "mitigation": "workaround",
    "resolution": "resolution", "resolutions": "resolution", "next step": "next_steps", "next steps": "next_steps",
}
WHOLLY_FIXED = r"(?i)\b(?:is|was|has been|have been|are)\s+(?:now\s+)?(?:fully\s+)?(?:resolved|fixed|addressed)\b"
UNNAMED_ISSUE = "bilinen sorun"

#: The fields whose change means something, and the two kinds of advice in generated texts.
SEMANTIC_FIELDS = ["status", "originating_kbs", "resolving_kbs", "partial_fix_kbs", "products", "tags", "kir", "stage", "change_kind", "platforms", "release_type", "builds", "versions", "support_end", "hotfix_type", "admin_action"]
FROM_SOURCE, INFERRED = "kaynak", "ai_cikarim"

#: Codes of places that are the seat of an administration, and the endings of districts' and provinces' names.
SEAT_CODES = ["PPLC", "PPLA", "PPLA2"]
DISTRICT_ENDING = r"\s+(?:İlçesi|ilçesi|İli|ili)$"

#: Fixed values: (pattern, label), in the order in which they are tried.
STATUS_RULES = [
    ("resolved external", "resolved_external"),
    ("resolved", "resolved"),
    ("mitigated external", "mitigated_external"),
    ("mitigated", "mitigated"),
    ("confirmed", "confirmed"),
    ("investigating|reported", "investigating"),
]
HOTFIX_RULES = [("summary of changes", "summary"), ("early update ring", "early_ring"), ("rollup", "rollup"), ("security", "security")]
CHANGE_RULES = [
    ("deprecat|retire|end of support|no longer support|will be removed|removal|sunset|kaldırıl", "deprecation"),
    ("plan for change|action required|(?:you|admins?) (?:need|must|should) to take action|take action before", "change"),
]
STAGE_RULES = [(r"\(preview\)|public preview|is (?:now )?in preview|now available in preview", "public_preview")]
#: Notes on licences, roll-outs and preparations, and the names of platforms.
LICENCE_NOTE = r"(?i)[^.\n]*(?:licen[cs]e|Intune Suite|Intune Plan 2|add-on|E3|E5|premium|requires? (?:a |an )?subscription)[^.\n]*\."
ROLLOUT_NOTE = r"(?i)[^.\n]*(?:gradual|rolling out|rolls out|rollout|over the coming weeks|phased)[^.\n]*\."
ADMIN_ACTION = r"(?is)How can you prepare\??(.+?)(?=\n#{2,4} |\z)"
PLATFORMS = {"windows": "windows", "ios": "ios|ipados", "macos": "macos", "android": "android", "linux": "linux"}

#: The order in which kinds of observations are matched, and the kind of the event that each begins.
KIND_PRIORITY = {"known_issue": 0, "cm_known_issue": 0, "kb_release": 1, "cm_version": 1, "cm_hotfix": 1, "feature": 2, "notice": 2, "announcement": 3, "field_report": 4, "article": 5, "content": 6}
EVENT_KIND = {
    "known_issue": "issue", "cm_known_issue": "issue", "field_report": "issue", "kb_release": "release", "cm_version": "version", "cm_hotfix": "hotfix",
    "feature": "feature", "notice": "notice", "announcement": "notice", "article": "news", "content": "content",
}

#: The order in which adapters depend on each other.
ADAPTER_ORDER = {"ms_update_history": 0, "wrh_status": 1, "wrh_resolved": 1, "wrh_messages": 2, "intune": 2, "cm_versions": 2, "cm_hotfix": 2, "cm_release_notes": 2, "cm_tp": 3, "ms_kb": 4, "rss": 5, "web_search": 6}

#: Turkish names of months and days; what labels are called in texts.
MONTHS_TR = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
DAYS_TR = ["Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi", "Pazar"]
PRODUCT_NAMES = {
    "win11-26h1": "Windows 11, sürüm 26H1", "win11-25h2": "Windows 11, sürüm 25H2", "win11-24h2": "Windows 11, sürüm 24H2", "win11-23h2": "Windows 11, sürüm 23H2", "win10-22h2": "Windows 10, sürüm 22H2 (ESU)", "win10-ltsc2021": "Windows 10 Enterprise LTSC 2021",
    "ws2025": "Windows Server 2025", "ws2022": "Windows Server 2022", "ws23h2": "Windows Server, sürüm 23H2", "ws2019": "Windows Server 2019 / Windows 10 1809", "ws2016": "Windows Server 2016 / Windows 10 1607",
}
TAG_NAMES = {
    "rds": "Uzak Masaüstü (RDS/RDP)", "dc": "Etki alanı denetleyicisi", "auth": "Kimlik doğrulama", "vpn": "VPN", "bitlocker": "BitLocker", "boot": "Açılış/başlatma", "network": "Ağ", "update_install": "Güncelleme kurulumu",
    "printing": "Yazdırma", "hyperv": "Hyper-V/küme", "avd": "AVD/FSLogix", "performance": "Performans", "audio": "Ses", "backup": "Yedekleme", "display": "Görüntü", "storage": "Depolama/dosya", "security": "Güvenlik (istismar)",
    "configmgr": "ConfigMgr", "intune": "Intune", "gpo": "Grup İlkesi", "iis": "IIS", "adcs": "Sertifika hizmetleri", "apps": "Uygulamalar", "shell": "Masaüstü/Explorer",
}
STATUS_NAMES = {
    "investigating": "İnceleniyor", "confirmed": "Doğrulandı (açık)", "mitigated": "Hafifletildi", "mitigated_external": "Hafifletildi (harici)", "resolved": "Çözüldü", "resolved_external": "Çözüldü (harici)",
    "reported": "Bildirildi (teyitsiz)", "unknown": "Bilinmiyor", "info": "Bilgi",
}
STAGE_NAMES = {"in_development": "Geliştirme aşamasında", "public_preview": "Public preview", "ga": "Genel kullanıma açıldı", "notice": "Önemli duyuru"}
RELEASE_NAMES = {"security": "Aylık güvenlik güncellemesi", "preview": "Preview (isteğe bağlı, güvenlik dışı)", "oob": "OOB (plan dışı)", "hotpatch": "Hotpatch güvenlik güncellemesi", "other": "Diğer güncelleme"}
HOTFIX_NAMES = {"summary": "Sürüm özeti (Current Branch)", "early_ring": "Early update ring", "rollup": "Update rollup", "security": "Güvenlik güncellemesi", "hotfix": "Hotfix", "current": "Current Branch", "tp": "Technical Preview"}
ROLE_NAMES = {
    "dc": "Etki alanı denetleyicisi (AD DS)", "rds": "Uzak Masaüstü Hizmetleri (RDS/RDP)", "hyperv": "Hyper-V / küme", "wsus": "WSUS / güncelleme dağıtımı", "print": "Yazdırma sunucusu", "vpn": "VPN / RRAS / Always On VPN", "iis": "IIS / web sunucusu",
    "fileserver": "Dosya sunucusu (SMB/DFS)", "adcs": "Sertifika hizmetleri (AD CS)", "sql": "SQL Server", "avd": "Azure Virtual Desktop / FSLogix", "bitlocker": "BitLocker kullanan istemciler", "autopilot": "Windows Autopilot", "comanagement": "Co-management (ConfigMgr + Intune)",
}
PLATFORM_NAMES = {"windows": "Windows", "ios": "iOS/iPadOS", "macos": "macOS", "android": "Android", "linux": "Linux"}
#: The lines of a detail text that only repeat its state.
STATUS_LINE = r"^[ \u00b7]*(?:Status|Originating update|History|Mitigated|Confirmed|Resolved|Investigating|OS Build|KB\d+|\d{4}-\d{2}-\d{2}|Last updated|Opened)\b"
