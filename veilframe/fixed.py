"""Vocabularies, formats, patterns and limits that results depend on.

Patterns are in Java syntax; group 2 is the value where a pattern has a cue.
"""

# ruff: noqa: E501

# --- fixed values: kinds and token prefixes, in output order ---
KINDS = ["EMAIL", "PHONE", "IBAN", "COMMERCIAL_REGISTRATION", "TAX_NUMBER", "NATIONAL_ID", "PERSON", "ORGANIZATION", "ADDRESS"]
PREFIX = {
    "EMAIL": "EMAIL",
    "PHONE": "PHONE",
    "IBAN": "IBAN",
    "COMMERCIAL_REGISTRATION": "CR",
    "TAX_NUMBER": "TAX_ID",
    "NATIONAL_ID": "GOV_ID",
    "PERSON": "PERSON",
    "ORGANIZATION": "ORG",
    "ADDRESS": "ADDRESS",
}
PUBLIC_PREFIXES = ["BANK", "TELCO", "CHANNEL", "PAYMENT_RAIL", "GOV"]
_PRIVATE = r"(?:EMAIL|PHONE|IBAN|CR|TAX_ID|GOV_ID|PERSON|ORG|ADDRESS)"
PRIVATE_TOKEN_BARE = rf"\b{_PRIVATE}_[A-F0-9]{{10,32}}\b"
PRIVATE_TOKEN = f"(?U){PRIVATE_TOKEN_BARE}"
PLACEHOLDER_BARE = rf"{PRIVATE_TOKEN_BARE}|\b(?:BANK|TELCO|CHANNEL|PAYMENT_RAIL|GOV)_[A-Z0-9_]+\b"
PLACEHOLDER = f"(?U){PLACEHOLDER_BARE}"
KEPT_VALUE = rf"^(?:{_PRIVATE}_[0-9a-fA-F]{{10,32}}|(?:BANK|TELCO|CHANNEL|PAYMENT_RAIL|GOV)_[A-Z0-9_]+)$"

# --- fixed values: characters ---
ARABIC_INDIC, PERSIAN = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
ARABIC_LETTERS = r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF"
INVISIBLE = r"[\u200B\u200E\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF\u00AD\u180E\x{E0000}-\x{E007F}]"
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X"}
MARKS = r"[\u064B-\u065F\u0670\u06D6-\u06ED\u0640]"
LETTER_FOLD = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"}
PARTICLES = ["بال", "وال", "فال", "كال", "لل", "ال", "ب", "و"]

# --- fixed values: numbers ---
IBAN_LENGTH = {"SA": 24, "AE": 23, "QA": 29, "KW": 30, "BH": 22, "OM": 23}
GULF_CODES = ["966", "971", "974", "965", "973", "968"]
KUWAIT_WEIGHTS = [2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]

_D = "0-9٠-٩۰-۹"
_IBAN = "|".join(rf"{c}(?:[\s\-]*[{_D}]){{2}}(?:[\s\-]*[A-Z{_D}]){{{n - 4}}}" for c, n in IBAN_LENGTH.items())
_CITY_AR = "الرياض|جدة|مكة|المدينة|الدمام|الخبر|الظهران|الهفوف|تبوك|أبها|ينبع|بريدة|نجران|حائل|جازان|الطائف"
_CITY_COMPOUND = "Riyadh|Jeddah|Makkah|Mecca|Madinah|Medina|Dammam|Khobar|Dhahran|Hofuf|Tabuk|Abha|Yanbu|Buraydah|Najran|Hail|Jazan|Taif"
_CITY_ANCHOR = "Riyadh|Jeddah|Makkah|Mecca|Madinah|Medina|Dammam|Khobar|Dhahran|Hofuf|Tabuk|Abha|Yanbu|Buraydah|Buraidah|Qassim|Najran|Hail|Jazan|Taif|Khamis Mushait|Ha'il"
_CITY_POSTAL = rf"Riyadh|Jeddah|Makkah|Mecca|Madinah|Medina|Dammam|Khobar|Dhahran|Hofuf|Tabuk|Abha|Yanbu|Buraydah|Buraidah|Najran|Hail|Jazan|Taif|Khamis\s+Mushait|Ha'il|{_CITY_AR}|خميس\s+مشيط"
_WORD_AR = r"(?:حي|شارع|طريق|مدينة|قرية|منطقة|ص\.?\s*ب|صندوق\s+بريد)(?:\s+[\p{IsArabic}A-Za-z0-9٠-٩]{2,30}){1,3}"

# --- fixed values: detector patterns, in order of emission ---
EMAIL = r"(?iU)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
IBAN = rf"(?iU)\b(?:{_IBAN})\b"
PHONE = (
    r"(?U)(?:(?:(?:\+|00)\s?)?\(?(?:\+\s?)?(?:966|971|974|965|973|968)\s?\)?(?:\s?[\-‐-―−]\s?)?"
    rf"(?:[\-\.()]{{0,2}}\s?[\-\.()]{{0,2}}[{_D}]){{6,12}})|(?:\b0?5[{_D}](?:[\s\-]?[{_D}]){{7}}\b)"
)
UAE_ID = rf"(?U)\b784[\- ]?[{_D}]{{4}}[\- ]?[{_D}]{{7}}[\- ]?[{_D}]\b"
SAUDI_ID = (
    r"(?iU)((?:رقم\s+)?(?:الهوية\s+الوطنية|هوية\s+الوطنية|الهوية|هوية|السجل\s+المدني|الإقامة|الاقامة|iqama|national\s*id|civil\s*id|saudi\s*id|nat\s*id"
    rf"|qatar\s*id\s*\(?qid\)?|qid|emirates\s*id|gcc\s*id|bahrain\s*id|kuwait\s*id|oman\s*id|id\s*(?:no|number|\#))\s*\.?\s*[:#\-]?\s*)([{_D}]{{8,15}})()"
)
GULF_ID = rf"(?iU)((?:civil\s*id|qatar\s*id|cpr|رقم\s+مدني|البطاقة\s+المدنية|الرقم\s+الشخصي|الرقم\s+المدني|الرقم\s+السکاني|الرقم\s+السكاني)\s*[:#\-]?\s*)([{_D}]{{8,12}})()"
SHAREHOLDER_ID = rf"(?U)([—–\-|]\s*)([{_D}]{{9,15}})(\s*[—–\-|])"
REGISTRATION = (
    r"(?iU)((?:رقم\s+)?(?:السجل\s+التجاري|سجل\s+تجاري|فرع\s+السجل\s+التجاري|س\.?\s*ت\.?|commercial\s+registration|branch\s*CR|civil\s+register(?:\s*(?:no|number))?"
    r"|company\s+registration(?:\s+number)?|registration\s+(?:no|number)|(?:\bCR\b|C\.R\.)(?:\s*(?:no|number|رقم|\#))?)"
    rf"(?:\s*\(\s*CR\s*\))?(?:\s+(?:no\.?|number|رقم))?\s*\.?\s*[:#\-/]?\s*)([A-Z{_D}][A-Z{_D}\-]{{4,18}})()"
)
TAX = (
    r"(?iU)((?:الرقم\s+الضريبي|رقم\s+ضريبي|ضريبة\s+القيمة\s+المضافة|القيمة\s+المضافة|VAT|TRN|tax\s*(?:id|number|no)|vat\s*(?:id|number|no)"
    rf"|taxpayer(?:\s*(?:id|no|number))?|tax\s+registration)\s*[:#\-/]?\s*)([{_D}]{{10,20}})()"
)
VAT_BARE = rf"(?U)\b[3٣۳][{_D}]{{13}}[3٣۳]\b"
BARE_15 = rf"(?U)\b[{_D}]{{15}}\b"
ADDRESS_CUE = r"(?U)((?:العنوان|عنوان العميل|address(?:\s+at)?|registered\s+address(?:\s+at)?)\s*[:#\-]?\s*)([\p{IsArabic}A-Za-z0-9٠-٩\s,\-/]{8,80})()"
BUILDING = r"(?iU)(\b(?:BLDG|BUILDING|UNIT|PLOT|رقم\s+(?:المبنى|قطعة|الوحدة))\b\s*\.?\s*(?:no\.?|number|\#)?\s*[:\-]?\s*)([A-Z0-9٠-٩][A-Z0-9٠-٩\-]{0,12})(\b)"
PO_BOX = r"(?iU)(\b(?:P\.?\s*O\.?\s*BOX|POST\s+BOX|ص\.?\s*ب\.?)\s*[:#\-]?\s*)(\d{1,7})(\b)"
POSTAL_CODE = r"(?iU)(\b(?:ZIP(?:\s+CODE)?|POSTAL\s+CODE|الرمز\s+البريدي)\s*[:#\-]?\s*)(\d{4,6})(\b)"
DISTRICT = r"(?U)(?:\b[A-Z][A-Za-z']{2,}\s+(?:District|Dist\.?|Neighborhood)\b)|(?:\b(?:District|Dist\.?|Neighborhood)\s+[A-Z][A-Za-z']{2,}\b)"
STREET = r"(?iU)(\b(?:Street|St\.?|Rd\.?|Road|Blvd\.?|Boulevard|Avenue|Ave\.?)\b\s*[:#\-]?\s*)([A-Z][A-Za-z' \-]{2,40})()"
ARABIC_STREET = r"(?U)\b(?:شارع|حي|طريق|مدينة|قرية|منطقة)\s+[\p{IsArabic}A-Za-z0-9]{2,30}"
ARABIC_COMPOUND = rf"(?U){_WORD_AR}(?:[\s,،]*(?:[\n]|\s{{2,}}|[,،])\s*(?:{_WORD_AR}|{_CITY_AR}|خميس\s+مشيط|{_CITY_COMPOUND})){{1,5}}(?:\s+[0-9٠-٩]{{4,5}}(?:[\-\s][0-9٠-٩]{{4}})?)?"
CITY_ANCHOR = rf"(?iU)[\p{{IsArabic}}A-Za-z][\p{{IsArabic}}A-Za-z0-9\s\.\-/]{{3,80}}[,،]\s*(?:{_CITY_ANCHOR}|{_CITY_AR}|خميس مشيط)(?:\s+\d{{4,5}})?\b"
ENGLISH_STREET = r"(?iU)\b(?:[A-Z][A-Za-z'\-]{1,30})(?:\s+[A-Z][A-Za-z'\-]{1,30}){0,4}\s+(?:Road|Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Highway|Hwy\.?|Lane|Way|District|Quarter|Neighborhood|Neighbourhood)\b"
CITY_AFTER_COMMA = rf"(?iU)[,،]\s*(?:{_CITY_ANCHOR}|{_CITY_AR}|خميس مشيط)"  # what CITY_ANCHOR cannot do without
STREET_NOUN = r"(?iU)\s(?:Road|Street|St|Avenue|Ave|Boulevard|Blvd|Highway|Hwy|Lane|Way|District|Quarter|Neighborhood|Neighbourhood)\b"  # likewise ENGLISH_STREET
CITY_POSTAL = rf"(?iU)(?:(?:{_CITY_POSTAL})\s*[,،\-]?\s*[0-9٠-٩]{{5}}(?:[\-\s][0-9٠-٩]{{4}})?|[0-9٠-٩]{{5}}(?:[\-\s][0-9٠-٩]{{4}})?\s*[,،\-]?\s*(?:{_CITY_POSTAL}))\b"

# --- fixed values: gates ---
TAX_DOCUMENT_LATIN = ["tax invoice", "simplified tax invoice", "vat", "trn", "tax registration", "e-invoice", "e invoice", "fatoora"]
TAX_DOCUMENT_ARABIC = ["فاتورة ضريبية", "ضريبة القيمة المضافة", "القيمة المضافة", "الرقم الضريبي", "رقم ضريبي"]
ADDRESS_STOP_NORMAL = ["بالضغط", "المختصر", "التفصيلي", "الوطني ومعلومات", "البريدي"]
ADDRESS_STOP_LOWER = ["the following", "tax registration", "stated in", "excuse of", "of the branch", "for e-com", "industry"]
GEO_HEAD = (
    r"(?iU)(?:شارع|حي|طريق|بناية|مبنى|عمارة|فيلا|شقة|صندوق\s+بريد|ص\.?\s*ب|الرمز\s+البريدي|العنوان|منطقة\s+تجارية|حي\s+تجاري|حي\s+سكني|المدينة\s+الصناعية)"
    r"|(?:street|st\.|road|rd\.|avenue|ave\.|boulevard|blvd\.|building|bldg\.|suite|ste\.|apt\.|apartment|p\.?\s*o\.?\s*box|postal\s+code|zip\s+code|industrial\s+(?:area|city))"
)
GEO_POSTAL = r"(?U)\b\d{4,5}\b"
GEO_BUILDING = r"(?iU)\b(?:#|No\.?|رقم|مبنى)\s*\d{1,5}\b"
GEO_WINDOW, GEO_CONFIDENCE, GEO_MIN = 80, 0.82, 2

# --- fixed values: context words before a span ---
CONTEXT_WORDS, CONTEXT_BOOST, CONTEXT_LEAST = 5, 0.35, 0.4
CONTEXT_TERMS = {
    "IBAN": ["iban", "آيبان", "ايبان", "الايبان", "حساب", "تحويل", "transfer", "swift"],
    "PHONE": ["phone", "mobile", "tel", "call", "جوال", "هاتف", "اتصل", "تواصل", "الجوال", "الهاتف"],
    "EMAIL": ["email", "mail", "بريد", "ايميل", "البريد"],
    "NATIONAL_ID": ["id", "iqama", "national", "هوية", "الهوية", "اقامة", "الاقامة", "مدني"],
    "COMMERCIAL_REGISTRATION": ["cr", "registration", "commercial", "سجل", "تجاري", "السجل"],
    "TAX_NUMBER": ["vat", "tax", "trn", "ضريبي", "ضريبة", "زكاة", "الضريبي"],
    "PERSON": ["mr", "mrs", "dr", "customer", "client", "name", "السيد", "السيدة", "العميل", "اسم", "الموظف", "المالك"],
    "ORGANIZATION": ["company", "co", "ltd", "llc", "شركة", "مؤسسة", "بنك", "مصرف"],
}

# --- fixed values: shapes of raw data that must not leave ---
LEAK_SHAPES = [
    r"(?iU)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b",
    r"(?U)\b(?:SA|AE|QA|KW|BH|OM)\d{2}[A-Z0-9 \-]{15,30}\b",
    r"(?U)(?:\+|00)?(?:966|971|974|965|973|968)[\s\-\.]?\d(?:[\s\-\.]?\d){6,10}",
    r"(?U)\b0?5\d(?:[\s\-]?\d){7}\b",
    r"(?U)\b784[\- ]?\d{4}[\- ]?\d{7}[\- ]?\d\b",
    r"(?U)\b(?:\d[ \-]?){13,19}\b",
    r"(?iU)\b(?:sk-[A-Za-z0-9_\-]{20,}|AKIA[0-9A-Z]{16}|(?:api[_\- ]?key|secret|token)\s*[:=]\s*[A-Za-z0-9_\-]{12,})\b",
]

# --- fixed values: structured keys, in order of trial ---
KEYS_SKIPPED = ["amount", "balance", "debit", "credit", "total", "subtotal", "tax_amount", "vat_amount", "date", "time", "row_index", "index", "page", "رصيد", "مدين", "دائن", "مبلغ", "تاريخ"]
KEY_GROUPS = [
    ("EMAIL", ["email", "e_mail", "mail", "بريد"]),
    ("PHONE", ["phone", "mobile", "tel", "جوال", "هاتف"]),
    ("IBAN", ["iban", "آيبان", "ايبان"]),
    ("COMMERCIAL_REGISTRATION", ["commercial_registration", "cr_number", "cr_no", "registration_number", "سجل", "تجاري", "س.ت"]),
    ("TAX_NUMBER", ["vat", "trn", "tax_number", "tax_id", "tin", "zakat", "ضريبة", "زكاة"]),
    ("NATIONAL_ID", ["national_id", "emirates_id", "civil_id", "iqama", "id_number", "هوية", "إقامة", "اقامة", "مدني"]),
    ("ORGANIZATION", ["company", "organization", "organisation", "merchant", "seller", "buyer", "beneficiary", "remitter", "sender", "receiver", "party", "vendor", "supplier", "شركة", "منشأة", "مؤسسة", "مستفيد", "مرسل", "بائع", "مشتري", "مورد"]),
    ("PERSON", ["person_name", "customer_name", "employee_name", "owner_name", "shareholder_name", "signatory", "director", "manager", "اسم", "عميل", "موظف", "مالك", "مساهم", "مفوض", "مدير"]),
]

# --- fixed values: column headers ---
HEADER_EMAIL = ["email", "e-mail", "بريد"]
HEADER_EMAIL_NOT = ["status", "source", "verif", "catch", "bounce", "confidence", "open", "sent", "last ", "score", "sync", "count", "name"]
HEADER_PHONE = ["phone", "mobile", "whatsapp", "هاتف", "جوال"]
HEADER_PHONE_EXACT = ["tel", "fax", "cell"]
HEADER_ADDRESS = ["street", "city", "state", "country", "region", "address", "location"]
HEADER_PERSON = ["first name", "last name", "full name", "middle name", "lead name", "lead owner", "account executive", "account owner", "contact owner", "previous owner", "converted contact", "owner", "contact", "contact name", "contact person", "name", "arabicname", "englishname", "الاسم", "اسم", "الاسم الكامل"]
HEADER_PERSON_NOT = ["company", "business", "account", "organization", "organisation", "ad ", "ad_", "adgroup", "campaign", "form", "page", "file", "product", "brand", "domain", "event", "stage", "template", "keyword", "display", "city", "country", "state", "industry", "tender", "supplier", "vendor", "for email", "group"]
HEADER_ORGANIZATION = ["company", "company name", "company name for emails", "business name", "business", "organization", "organisation", "employer", "account", "converted account", "referrer account", "referrer vendor", "vendor", "supplier", "suppliername", "partner", "account name", "اسم الشركة", "الشركة"]

# --- fixed values: streams, limits, model labels ---
CARRY_LIMIT, FUZZY_DISTANCE, TOP_FILES = 64, 2, 10
CELL_END, ROW_END, FIELD_END = "\x1f", "\x1e", "\x1f"
DELTA_FIELD = {"text_delta": "text", "thinking_delta": "thinking", "input_json_delta": "partial_json"}
STREAM_ENDS = ["message_stop", "response.completed"]
RESPONSE_DELTAS = ["response.output_text.delta", "response.refusal.delta", "response.reasoning_text.delta", "response.reasoning_summary_text.delta", "response.function_call_arguments.delta"]
WRITE_TOOLS = ["Write", "Edit", "MultiEdit", "NotebookEdit"]
CONNECTIVES = ["bin", "ibn", "bint", "bn", "بن", "ابن", "بنت"]
LABEL_FAMILIES = {"PER": "PERSON", "PERS": "PERSON", "PERSON": "PERSON", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "LOC": "ADDRESS", "LOCATION": "ADDRESS", "GPE": "ADDRESS", "FAC": "ADDRESS"}
MODEL_THRESHOLD, MODEL_WINDOW = 0.85, 500
SEGMENT_EXTENSIONS = {"txt": "TXT", "md": "MD", "markdown": "MD", "csv": "CSV", "json": "JSON", "html": "HTML", "htm": "HTML", "docx": "DOCX", "xlsx": "XLSX", "pdf": "PDF"}
