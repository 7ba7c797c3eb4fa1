"""Word lists, patterns and formats that results depend on.

They are data, not logic, and are stated in one place so that a deployment can compare or
replace them. Patterns are Java regular expressions; ``(?iu)`` folds case outside ASCII too.
"""

# Size units, powers of 1024.
SIZE_LABELS = ("B", "KB", "MB", "GB", "TB")
SIZE_UNITS = {
    "TB": 1024**4, "ТБ": 1024**4,
    "GB": 1024**3, "ГБ": 1024**3,
    "MB": 1024**2, "МБ": 1024**2,
    "KB": 1024, "КБ": 1024,
}
SIZE_PATTERN = r"(?iu)(\d+(?:[.,]\d+)?)\s*(TB|GB|MB|KB|ТБ|ГБ|МБ|КБ)"
EXACT_BYTES_PATTERN = r"(?i)\((\d+)\s*Bytes\)"

# Month names. Short forms default to January, genitive forms do not default.
SHORT_MONTHS = {
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "июн": 6,
    "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12,
}
GENITIVE_MONTHS = {
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6,
    "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12,
}
ENGLISH_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
LONG_DATE_PATTERN = (
    r"(?iu)(\d{1,2})\s+([а-яё]+)\s+(\d{4})(?:\s+в\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
)
# Unix seconds are taken as a date only strictly between these (years 2000 and 2100).
UNIX_DATE_RANGE = (946_684_800, 4_102_444_800)

# Link parsing.
HASH_TOPIC_PATTERN = r"urn(?::|%3A)(?:btih|btmh(?::|%3A)1220)[^&#]*"
HASH_PREFIX_PATTERN = r"(?i)^urn:(?:btih:|btmh:1220)"
BASE32_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
LINK_V1 = "magnet:?xt=urn:btih:"
LINK_V2 = "magnet:?xt=urn:btmh:1220"

# Sensitive words, by where they are looked for.
SENSITIVE_PARAMETER = (
    r"(?iu)cookie|authorization|password|парол|login|логин|token|session|passkey|proxy|user"
)
SENSITIVE_KEY = (
    r"(?iu)(^|[_.\-])(cookie|authorization|password|парол|login|логин|token|session|passkey"
    r"|proxy|user)([_.\-]|$)"
)
SENSITIVE_LABEL = (
    r"(?iu)cookie|authorization|password|парол|login|логин|token|session|passkey|залил"
    r"|uploader|user|добавить в"
)
SENSITIVE_QUERY = r"(?i)(?:token|auth|session|password|cookie)="
STRIPPED_QUERY_KEY = (
    r"(?i)^(?:passkey|token|auth|authorization|cookie|session|password|user)$"
)
TELEMETRY_LABEL = (
    r"(?iuU)сид(?:ер)?\s*(?:был|замечен)|последн\w*\s+сид|seed(?:er)?\s*(?:last\s*)?seen"
    r"|last\s*seed|скорост\w*|время\s+(?:онлайн|раздач)"
    r"|(?:transfer|upload|download)\s*speed|time\s*online"
)
TELEMETRY_PART = (
    r"(?iuU)скорост|(?:upload|download|transfer)\s*(?:speed|rate)|сид(?:ер)?\s*(?:был|замечен)"
    r"|последн(?:ий|яя)?\s*сид|last\s*seed|seed(?:er)?\s*(?:last\s*)?seen"
    r"|время\s*(?:онлайн|раздачи)|time\s*online"
)

# Page classes.
CHALLENGE_MARKERS = (
    "cf-chl-", "cf_chl", "Just a moment", "Checking your browser", "challenge-platform",
    "ddos-guard",
)
AUTHENTICATION_MARKERS = ('"Unauthenticated."', 'name="login_username"')

# Title parsing.
YEAR_PATTERN = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
# Video types, by the family of sources whose titles are read.
VIDEO_TYPE_PATTERNS = {
    "short": r"(?i)\b(?:UHD\s+BDRemux|UHD\s+BDRip(?:-HEVC)?|BDRemux|BDRip(?:-HEVC)?|WEB-DL(?:Rip)?|WEBRip|HDRip(?:-AVC)?|DVDRip)\b",
    "broadcast": r"(?i)\b(?:UHD\s+BDRemux|UHD\s+BDRip(?:-HEVC)?|BDRemux|BDRip(?:-HEVC)?|WEB-DL(?:Rip)?|WEBRip|HDRip(?:-AVC)?|DVDRip|HDTVRip?)\b",
    "remux": r"(?i)\b(?:UHD\s+BDRemux|UHD\s+BDRip(?:-HEVC)?|Blu-Ray\s+Remux|BDRemux|BDRip(?:-(?:HEVC|AVC))?|WEB-DL(?:Rip)?(?:-HEVC)?|WEBRip|HDRip(?:-AVC)?|DVDRip)\b",
    "full": r"(?i)\b(?:UHD\s+BDRemux|UHD\s+BDRip(?:-HEVC)?|Blu-Ray\s+Remux|BDRemux|BDRip(?:-(?:HEVC|AVC))?|WEB-DL(?:Rip)?(?:-HEVC)?|WEBRip|HDRip(?:-AVC)?|DVDRip|HDTVRip?)\b",
    "fact": r"(?i)\b(?:UHD\s+BDRemux|UHD\s+BDRip|BDRemux|BDRip|WEB-DL(?:Rip)?|WEBRip|HDRip|DVDRip|HDTVRip?)\b",
}
SEASON_PATTERNS = {
    "s_range": r"(?i)\bS(\d{1,2})(?:-(\d{1,2}))?\b",
    "bracket": r"(?iu)\[(\d{1,2})(?:-(\d{1,2}))?\s*сезон",
    "word": r"(?iu)(?:\bS|сезон\s+)(\d{1,2})(?:-(\d{1,2}))?",
    "anime": r"(?iuU)(?:\bS|\[ТВ-?|\bсезон\s*)(\d{1,2})()",
}
MAX_SEASON = 100
MAX_SEASON_SPAN = 30
EPISODIC_MARKER = r"(?iuU)\b(?:сезон|серии?|S\d{1,2}|E\d{1,3})\b"

# Structured titles, tried in this order: pattern, and whether its second group is an original name.
MOVIE_PATTERNS = (
    (r"^([^/\(\[]+) / [^/\(\[]+ / ([^/\(\[]+) \([^\)]+\) \[([0-9]+), ", True),
    (r"^([^/\(\[]+) / ([^/\(\[]+) \([^\)]+\) \[([0-9]+), ", True),
    (r"^([^/\(\[]+) \([^\)]+\) \[([0-9]+), ", False),
)
SERIAL_PATTERNS = (
    (r"(?iu)^([^/\(\[]+) / [^/\(\[]+ / [^/\(\[]+ / ([^/\(\[]+) / Сезон: [^/]+ / [^\(\[]+ \([^\)]+\) \[([0-9]+)(,|-)", True),
    (r"(?iu)^([^/\(\[]+) / [^/\(\[]+ / ([^/\(\[]+) / Сезон: [^/]+ / [^\(\[]+ \([^\)]+\) \[([0-9]+)(,|-)", True),
    (r"(?iu)^([^/\(\[]+) / ([^/\(\[]+) / Сезон: [^/]+ / [^\(\[]+ \([^\)]+\) \[([0-9]+)(,|-)", True),
    (r"(?iu)^([^/\(\[]+) / Сезон: [^/]+ / [^\(\[]+ \([^\)]+\) \[([0-9]+)(,|-)", False),
    (r"(?iu)^([^/\(\[]+) / [^/\(\[]+ / ([^/\(\[]+) / [^\(\[]+ \([^\)]+\) \[([0-9]+)(,|-)", True),
    (r"(?iu)^([^/\(\[]+) / ([^/\(\[]+) / [^\(\[]+ \([^\)]+\) \[([0-9]+)(,|-)", True),
)

# Language evidence: fragment of the text and the name it stands for.
LANGUAGES = {
    "рус": "Русский", "англ": "Английский", "укра": "Украинский", "япон": "Японский",
}
LANGUAGE_LABEL = r"(?iu)^(?:аудио|субтитры$|язык$)"
LANGUAGE_NAME = (
    r"(?iu)^(Русск(?:ий|ие)|Английск(?:ий|ие)|Украинск(?:ий|ие)|Японск(?:ий|ие)"
    r"|Немецк(?:ий|ие)|Французск(?:ий|ие))(?U:\b)"
)

# Content types a result may have.
ALLOWED_TYPES = (
    "movie", "serial", "anime", "multfilm", "multserial",
    "documovie", "docuserial", "tvshow", "sport",
)
# Slug fragments of a category and the type they stand for, tried in this order.
CATEGORY_SLUGS = (
    ("nashi_seriali", "serial"), ("seriali", "serial"), ("anime", "anime"),
    ("nauchno", "documovie"), ("науч", "documovie"), ("sport", "sport"), ("спорт", "sport"),
    ("nashe_kino", "movie"), ("kino", "movie"), ("tv", "tvshow"), ("multiki", "multfilm"),
)
# Release types counted as playable; a release without a type is playable too.
PLAYABLE_TYPES = ("TV", "TV_SHORT", "MOVIE", "OVA", "ONA", "SPECIAL")

# Page text.
HASH_TEXT_PATTERN = (
    r"(?iu)(?:инфо[ -]?хеш|info[ -]?hash|хеш)\s*:?[\s\[]*([a-f0-9]{40}|[a-f0-9]{64}|[a-z2-7]{32})"
)
PIECE_SIZE_PATTERN = (
    r"(?iuU)Размер\s+части\s+торрента\s*:\s*(\d+(?:[.,]\d+)?\s*(?:ТБ|ГБ|МБ|КБ|TB|GB|MB|KB))"
)
FORMAT_PATTERN = r"(?i)(?:^|\n)Format\s*:\s*([^\r\n]+)"
AUTHOR_PATTERN = r"(?iU)(?:^|\s)by:\s*(.+?)\s*$"
DOWNLOAD_PREFIX = "Скачать "
MAX_LABEL = 80
