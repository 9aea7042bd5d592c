"""Words and patterns that results depend on."""

# Words of the listing sites that must be matched exactly.

# Path parts by which a link is known to be a posting.
POSTING_PATHS = ["/job/", "/vacancy/", "/vacancies/", "/elan/", "/announcement/"]
# Query parts accepted in addition when a single card is checked.
POSTING_QUERIES = ["job=", "vacancy=", "vacancies="]
ID_QUERY = "id="
# The one path part of the site whose cards use the separator sign.
SEPARATOR_SITE_PATH = "/vacancies/"

UNKNOWN = "Unknown"
CARD_SEPARATOR = "●"
PLACE_WORDS = [
    "Bakı", "Gəncə", "Sumqayıt", "Mingəçevir", "Naxçıvan",
    "Şəki", "Lənkəran", "remote", "Remote", "Baku",
]
YESTERDAY = "dünən"
TODAY = "bugün"

# Headings of a detail page.
DESCRIPTION_HEADING = "Təsvir"
REQUIREMENTS_HEADING = "Tələblər"
CATEGORY_HEADING = "Kateqoriya"
SIDEBAR_HEADING = "Vakansiya haqqında"
SECTION_CLASS = "description-html"
SIDEBAR_ROW_CLASSES = ["flex", "justify-between"]
NUMBER_BOX_CLASSES = ["flex", "items-center"]

# Sidebar labels in the order they are tested, with the field each one fills.
SIDEBAR_LABELS = [
    ("Son tarix", "deadline"),
    ("Vakansiya növü", "job_type"),
    ("Vəzifə dərəcəsi", "job_level"),
    ("Təhsil", "education"),
]
JOB_TYPE_WORDS = ["Tam ştat", "Yarım ştat", "Frilans", "Müqavilə", "Təcrübə", "Daimi"]

CURRENCY_WORDS = ["AZN", "manat"]
CURRENCY_CODE = "AZN"

# Section markers inside a combined text, in the order they are tried.
REQUIREMENT_MARKERS = [
    "Namizədə olan tələblər", "Tələblər:", "Tələblər", "Namizədə tələblər",
    "Requirements:", "Requirements", "Tələb olunan bacarıqlar",
]
DESCRIPTION_MARKERS = [
    "Vəzifə və öhdəliklər", "Vəzifə öhdəlikləri", "Öhdəliklər:", "Öhdəliklər",
    "İş vəzifələri", "Responsibilities", "İş haqqında", "İş şəraiti",
]

JOB_TYPE_LABELS = [
    ("tam ştat", "Tam ştat"), ("full-time", "Full-time"), ("full time", "Full-time"),
    ("yarım ştat", "Yarım ştat"), ("part-time", "Part-time"), ("part time", "Part-time"),
    ("frilans", "Frilans"), ("freelance", "Freelance"), ("müqavilə", "Müqavilə"),
    ("contract", "Contract"), ("remote", "Remote"), ("uzaqdan", "Uzaqdan"),
    ("hibrid", "Hibrid"), ("hybrid", "Hybrid"),
]
EDUCATION_LABELS = [
    ("ali təhsil", "Ali"), ("bakalavr", "Bakalavr"), ("magistr", "Magistr"),
    ("orta təhsil", "Orta"), ("natamam ali", "Natamam ali"), ("bachelor", "Bachelor"),
    ("master", "Master"),
]

# Script payload of the single-page site.
PAYLOAD_MARKER = "__NUXT__"
PAYLOAD_OUTER = "tab_data"
PAYLOAD_INNER = "vacancy"
PAYLOAD_FIELDS = ["text", "category", "deadline_at", "salary", "v_count"]
PAYLOAD_CATEGORY_TITLE = "title"

# Message layout.
MESSAGE_LIMIT = 4096
LABEL_ALLOWANCE = 50
ELLIPSIS = "..."
DEFAULT_KEYWORDS = "Python,SQL"
MESSAGE_LABELS = {
    "title": "💼 <b>{}</b>",
    "company": "🏢 {}",
    "location": "📍 {}",
    "job_type": "⏰ {}",
    "job_level": "📊 Səviyyə: {}",
    "category": "📁 Kateqoriya: {}",
    "salary": "💰 Maaş: {}",
    "posted_date": "📅 Paylaşılıb: {}",
    "deadline": "⏳ Son tarix: {}",
    "views": "👁 Baxış: {}",
    "description": "\n📝 <b>Təsvir:</b>\n{}",
    "requirements": "\n✅ <b>Tələblər:</b>\n{}",
    "link": "\n🔗 <a href=\"{}\">Ətraflı bax</a>",
}
RETRY_PATTERN = r"Retry in (\d+) seconds"
