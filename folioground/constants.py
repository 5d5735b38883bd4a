"""Word lists, lookup tables, patterns, texts and limits.

Everything in this module is a fixed value that results depend on. Order is
significant in every table of labels: the first label that matches wins.
"""

# ---- limits -----------------------------------------------------------------
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MIN_NATIVE_WORDS = 15
OCR_REVIEW_BELOW = 70.0
OCR_DEFAULT_CONFIDENCE = 85.0
CHUNK_MAX_WORDS = 350
CHUNK_OVERLAP_WORDS = 40
CHUNK_MIN_WORDS = 5
CHUNK_MIN_ALNUM = 10
EMBEDDING_DIM = 1536
EMBEDDING_MODEL = "text-embedding-3-small"
SCORE_THRESHOLD = 0.50
SUFFICIENCY_SCORE = 0.45
SUFFICIENCY_OVERLAP = 0.20
CLAIM_OVERLAP_CITED = 0.15
CLAIM_OVERLAP_UNCITED = 0.20
EVIDENCE_OVERLAP = 0.25
DEFAULT_LIMIT = 5
NAMESPACE_PREFIX = "corpus"

# ---- document states --------------------------------------------------------
ACTIVE, ARCHIVED, PROCESSING, FAILED, DELETED = (
    "ACTIVE", "ARCHIVED", "PROCESSING", "FAILED", "DELETED")

# ---- roles and permissions --------------------------------------------------
ROLE_PERMISSIONS = {
    "SYSTEM_ADMIN": [
        "admin:all", "users:manage", "audit:read", "docs:all", "docs:upload",
        "docs:process", "docs:archive", "docs:delete", "collections:manage",
        "query:execute", "citations:preview", "feedback:submit",
        "history:read", "eligibility:check",
    ],
    "SCHEME_ADMIN": [
        "docs:upload", "docs:process", "docs:archive", "docs:delete",
        "docs:all", "collections:manage", "audit:read", "query:execute",
        "citations:preview", "feedback:submit",
    ],
    "HELPDESK": [
        "query:execute", "citations:preview", "feedback:submit",
        "history:read", "eligibility:check",
    ],
    "CITIZEN": ["query:execute", "citations:preview", "feedback:submit"],
}
PRIVATE_ACCESS = ["admin:all", "docs:all", "collections:manage"]
LISTING_ACCESS = ["admin:all", "collections:manage"]
HISTORY_ACCESS = ["admin:all", "docs:all", "docs:archive"]
ARCHIVE_LISTING_ACCESS = ["admin:all", "docs:all"]

# ---- line patterns ----------------------------------------------------------
HEADING_NUMBERED_SECTION = r"(?i)^(?:section\s+\d+|clause\s+\d+|article\s+\d+|chapter\s+\d+)\b[:.\-]?\s*.*$"
HEADING_NUMBERED_TITLE = r"^\d+(?:\.\d+)*\.?\s+[A-Za-z0-9\s,\-()/']{2,80}$"
HEADING_MARKDOWN = r"^#{1,6}\s+.*$"
HEADING_CAPS_COLON = r"^[A-Z0-9\s,\-()/']{4,80}:(?:\s*.*)?$"
HEADING_LEAD_WORD = (
    r"(?i)^(?:eligibility|benefits|application process|documents required"
    r"|financial assistance|guidelines|overview|terms and conditions"
    r"|objectives|target group)\b.*$")
HEADING_PATTERNS = [
    HEADING_NUMBERED_SECTION, HEADING_NUMBERED_TITLE, HEADING_MARKDOWN,
    HEADING_CAPS_COLON, HEADING_LEAD_WORD,
]
TABLE_LINE = (
    r"^(?:\|.*\||\b[A-Za-z0-9\s]{2,30}\s*:\s*.+"
    r"|[\-*]\s+[A-Za-z0-9\s]{2,30}\s*:\s*.+)")

# ---- words that carry no content --------------------------------------------
STOPWORDS = [
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "in", "for",
    "to", "of", "what", "how", "who", "when", "where", "why", "can", "i",
    "you", "my", "about", "with", "from", "by", "under", "do", "does", "are",
    "be", "am",
]
CONTENT_WORD = r"\b[a-zA-Z0-9_-]{3,}\b"

# ---- answer texts -----------------------------------------------------------
NO_ANSWER = (
    "The requested information was not found in the selected uploaded documents. "
    "The requested query was not found in the uploaded official scheme documents.")
NO_ANSWER_PLAIN = (
    NO_ANSWER + " No answer is given from general model knowledge without "
    "verified source citations.")
NO_ANSWER_FOLLOW_UP = NO_ANSWER + " To evaluate your eligibility safely without guessing: "
NO_ANSWER_UNVERIFIED = (
    NO_ANSWER + " Generated claims could not be verified against the uploaded "
    "document excerpts.")
NO_ANSWER_NO_PASSAGE = (
    NO_ANSWER + " No verified supported passages are available to synthesize an answer.")
NO_ANSWER_BAD_CITATIONS = (
    NO_ANSWER + " Citations could not be validated against official uploaded "
    "documents for this collection.")
FOLLOW_UP_NOTE = " Note: To determine your personal eligibility safely: "
WARN_NO_CITATION = (
    "Warning: The answer could not be fully verified against official document records. "
    "No supported citations were confirmed for this collection.")
WARN_UNVERIFIED = (
    "Warning: This answer could not be fully verified against official document records. "
    "One or more factual claims lacked verified citations.")

# ---- information types ------------------------------------------------------
INFORMATION_TYPES = {
    "eligibility": [
        "eligible", "eligibility", "qualify", "criteria", "who can apply", "can i get",
        "am i eligible", "can i apply", "can i avail", "am i entitled", "entitlement",
        "age limit", "income limit", "conditions", "prerequisites", "allowed"],
    "benefit": [
        "benefit", "benefits", "how much money", "financial assistance", "amount", "subsidy",
        "pension amount", "grant", "stipend amount", "installment", "cash transfer", "how much"],
    "documents": [
        "document", "documents", "paper", "papers", "paperwork", "certificate", "id proof",
        "proof of", "aadhaar", "ration card", "income certificate", "caste certificate",
        "what documents"],
    "process": [
        "how to apply", "application process", "process", "procedure", "where to apply",
        "online application", "portal", "registration", "steps", "apply online", "fill form"],
    "deadline": [
        "deadline", "last date", "due date", "closing date", "cutoff", "expiry", "end date",
        "final date", "time limit"],
    "contact": [
        "contact", "helpline", "phone number", "toll free", "toll-free", "email", "officer",
        "nodal officer", "office address", "counter", "helpdesk", "whom to contact"],
    "status": [
        "status", "application status", "track", "tracking", "check status", "reference number",
        "application number", "list", "name in list", "beneficiary list"],
}

# ---- scheme categories ------------------------------------------------------
SCHEME_CATEGORIES = {
    "housing": ["housing", "house", "awas", "pmay", "shelter", "home loan", "clss", "basti",
                "slum"],
    "agriculture": ["agriculture", "farmer", "farming", "kisan", "crop", "fertilizer",
                    "irrigation", "pm-kisan", "pm kisan", "landholding", "fpo", "mandi", "seed"],
    "healthcare": ["healthcare", "health", "medical", "ayushman", "pmjay", "hospital",
                   "treatment", "medicine", "insurance", "arogya", "swasthya", "clinic"],
    "education": ["education", "scholarship", "school", "college", "tuition", "student",
                  "stipend", "fellowship", "fee waiver", "vidya", "coaching", "hostel"],
    "pension": ["pension", "retirement", "epfo", "atal pension", "old age pension", "ignoaps",
                "superannuation", "monthly pension", "elderly pension"],
    "social_security": ["social security", "welfare", "bpl", "subsidy", "ration",
                        "food security", "destitute", "annapurna", "antyodaya", "ration card"],
    "women_and_child": ["maternal", "maternity", "pregnancy", "pregnant", "girl child",
                        "sukanya", "ladli", "poshan", "anganwadi", "matru vandana",
                        "beti padhao"],
    "employment": ["employment", "job", "mgnregs", "mgnrega", "skill", "training", "apprentice",
                   "rozgar", "pmkvy", "unemployed", "wage", "work"],
    "sanitation": ["sanitation", "toilet", "swachh", "swachh bharat", "drainage", "sewer",
                   "hygiene"],
    "energy": ["electricity", "solar", "lpg", "ujjwala", "gas cylinder", "gas connection",
               "power", "urja"],
    "finance": ["loan", "mudra", "credit", "subsidy", "bank account", "jan dhan", "insurance",
                "financial assistance", "cash grant", "interest subsidy"],
    "disability": ["disability", "divyang", "divyangjan", "handicap", "pwd",
                   "aid and appliance", "wheelchair", "tricycle", "prosthetic"],
}

# ---- beneficiary types ------------------------------------------------------
BENEFICIARY_TYPES = {
    "shg": ["shg", "self help group", "women group", "samiti"],
    "farmer": ["farmer", "farmers", "kisan", "cultivator", "sharecropper",
               "agricultural worker"],
    "student": ["student", "students", "scholar", "scholars", "pupil", "youth", "learner"],
    "senior_citizen": ["senior citizen", "senior citizens", "elderly", "aged", "old age",
                       "pensioner"],
    "widow": ["widow", "widows", "destitute woman", "single mother"],
    "artisan": ["artisan", "artisans", "weaver", "weavers", "craftsman", "carpenter",
                "blacksmith", "potter", "handicraft worker"],
    "unorganized_worker": ["unorganized worker", "daily wage worker", "construction worker",
                           "laborer", "labourer", "migrant worker", "street vendor"],
    "bpl_family": ["bpl", "below poverty line", "ews", "poor family", "low income family",
                   "antyodaya"],
    "person_with_disability": ["pwd", "disabled", "person with disability", "divyang",
                               "differently abled"],
    "woman": ["woman", "women", "female", "girl", "mother", "lady"],
    "individual": ["individual", "citizen", "person", "applicant"],
}

# ---- occupations ------------------------------------------------------------
OCCUPATIONS = {
    "farmer": ["farmer", "cultivator", "agricultural labourer", "sharecropper", "farm worker"],
    "artisan": ["artisan", "weaver", "craftsman", "carpenter", "blacksmith", "potter", "mason",
                "sculptor"],
    "construction_worker": ["construction worker", "building worker", "daily wage worker",
                            "coolie", "mazdoor"],
    "street_vendor": ["street vendor", "vendor", "hawker", "cart puller", "small shopkeeper"],
    "student": ["student", "research scholar", "postgraduate", "undergraduate"],
    "healthcare_worker": ["asha worker", "anganwadi worker", "nurse", "paramedic"],
    "fisherman": ["fisherman", "fisherfolk", "aquaculture worker"],
    "domestic_worker": ["domestic worker", "maid", "cook", "cleaner", "housekeeper"],
    "unemployed": ["unemployed", "job seeker", "fresher"],
}

# ---- states, with other spellings -------------------------------------------
STATES = {
    "andhra pradesh": "Andhra Pradesh",
    "arunachal pradesh": "Arunachal Pradesh",
    "assam": "Assam",
    "bihar": "Bihar",
    "chhattisgarh": "Chhattisgarh",
    "goa": "Goa",
    "gujarat": "Gujarat",
    "haryana": "Haryana",
    "himachal pradesh": "Himachal Pradesh",
    "jharkhand": "Jharkhand",
    "karnataka": "Karnataka",
    "kerala": "Kerala",
    "madhya pradesh": "Madhya Pradesh",
    "maharashtra": "Maharashtra",
    "manipur": "Manipur",
    "meghalaya": "Meghalaya",
    "mizoram": "Mizoram",
    "nagaland": "Nagaland",
    "odisha": "Odisha",
    "orissa": "Odisha",
    "punjab": "Punjab",
    "rajasthan": "Rajasthan",
    "sikkim": "Sikkim",
    "tamil nadu": "Tamil Nadu",
    "telangana": "Telangana",
    "tripura": "Tripura",
    "uttar pradesh": "Uttar Pradesh",
    "uttarakhand": "Uttarakhand",
    "west bengal": "West Bengal",
    "delhi": "Delhi",
    "jammu and kashmir": "Jammu and Kashmir",
    "ladakh": "Ladakh",
    "puducherry": "Puducherry",
    "chandigarh": "Chandigarh",
    "national": "National / All India",
    "all india": "National / All India",
}

# ---- districts as "District, State" -----------------------------------------
DISTRICTS = {
    "mumbai": "Mumbai, Maharashtra",
    "pune": "Pune, Maharashtra",
    "nagpur": "Nagpur, Maharashtra",
    "bengaluru": "Bengaluru, Karnataka",
    "bangalore": "Bengaluru, Karnataka",
    "mysuru": "Mysuru, Karnataka",
    "hyderabad": "Hyderabad, Telangana",
    "chennai": "Chennai, Tamil Nadu",
    "coimbatore": "Coimbatore, Tamil Nadu",
    "madurai": "Madurai, Tamil Nadu",
    "varanasi": "Varanasi, Uttar Pradesh",
    "lucknow": "Lucknow, Uttar Pradesh",
    "kanpur": "Kanpur, Uttar Pradesh",
    "jaipur": "Jaipur, Rajasthan",
    "jodhpur": "Jodhpur, Rajasthan",
    "ahmedabad": "Ahmedabad, Gujarat",
    "surat": "Surat, Gujarat",
    "patna": "Patna, Bihar",
    "kolkata": "Kolkata, West Bengal",
    "bhopal": "Bhopal, Madhya Pradesh",
    "indore": "Indore, Madhya Pradesh",
    "ranchi": "Ranchi, Jharkhand",
    "chandigarh": "Chandigarh, Chandigarh",
}

# ---- profile terms ----------------------------------------------------------
PROFILE_TERMS = {
    "student": ["student", "students", "scholar"],
    "farmer": ["farmer", "farmers", "kisan", "cultivator"],
    "widow": ["widow", "widows"],
    "senior-citizen": ["senior citizen", "senior citizens", "elderly", "pensioner", "aged"],
    "bpl": ["bpl", "below poverty line", "antyodaya", "ews"],
    "artisan": ["artisan", "artisans", "weaver", "weavers", "craftsman"],
    "disabled": ["pwd", "disabled", "disability", "divyang"],
    "transgender": ["transgender", "third gender"],
    "unorganized-worker": ["daily wage worker", "construction worker", "laborer", "labourer",
                           "migrant worker", "vendor"],
    "woman": ["woman", "women", "female", "girl child", "mother"],
    "sc-st": ["sc", "st", "scheduled caste", "scheduled tribe", "dalit", "adivasi"],
    "minority": ["minority", "minorities"],
}
PROFILE_BACKFILL = [
    ("widow", "widow"), ("student", "student"), ("farmer", "farmer"),
    ("senior-citizen", "senior_citizen")]

#: Every keyword of the tables above, each once.
ALL_KEYWORDS = sorted({k for table in (INFORMATION_TYPES, SCHEME_CATEGORIES, BENEFICIARY_TYPES, OCCUPATIONS, PROFILE_TERMS) for ks in table.values() for k in ks}
                      | {*STATES, *DISTRICTS})

# ---- question patterns ------------------------------------------------------
AGE_PATTERNS = [
    r"\b(?:age(?:d)?|years? old)\s*[:=]?\s*(\d{1,3})\b",
    r"\b(\d{1,3})\s*(?:years?(?:\s*old)?|yo|yrs?)\b",
    r"\b(?:above|over|more than|exceeding)\s*(\d{1,3})\b",
    r"\b(?:under|below|less than)\s*(\d{1,3})\b",
    r"\bage\s*of\s*(\d{1,3})\b",
    r"\bi am\s*(\d{1,3})\b",
]
GENDERS = [
    ("transgender", r"\b(transgender|trans\s*woman|trans\s*man|third\s*gender)\b"),
    ("female", r"\b(woman|women|female|girl|mother|widow|daughter|she|her|lady)\b"),
    ("male", r"\b(man|men|male|boy|father|son|he|him|gentleman)\b"),
]
INCOME_BANDS = [
    ("BPL", r"\b(bpl|below poverty line)\b", 150000.0),
    ("EWS", r"\b(ews|economically weaker section)\b", 300000.0),
    ("Antyodaya", r"\b(antyodaya|aay)\b", 100000.0),
]
INCOME_AMOUNT = (
    r"\b(?:income|salary|earnings?)\s*(?:is|of|below|under|up\s*to|<|less\s*than)?\s*"
    r"(?:rs\.?|inr)?\s*([\d,]+(?:\.\d+)?)\s*(lakh|lakhs|lac|k|thousand|crore)?\b")
INCOME_STANDALONE = (
    r"\b(?:under|below|less\s*than|up\s*to)\s*(?:rs\.?|inr)?\s*([\d.]+)\s*(lakh|lakhs|lac)\b")
INCOME_UNITS = {"lakh": 100000.0, "lakhs": 100000.0, "lac": 100000.0, "k": 1000.0,
                "thousand": 1000.0, "crore": 10000000.0}
LOCALITIES = [
    ("rural", r"\b(rural|village|gram\s*panchayat|taluka|tehsil)\b"),
    ("urban", r"\b(urban|city|town|municipality|municipal|metro|slum)\b"),
]
DISABILITY = (
    r"\b(pwd|disabled|disability|divyang|divyangjan|handicapped|physically challenged|blind"
    r"|visually impaired|locomotor|hearing impaired)\b")
DISABILITY_PERCENT = r"\b(\d{1,3})%\s*(?:disability|benchmark)?\b"

# ---- follow-up questions ----------------------------------------------------
FOLLOW_UPS = {
    "annual_income":
        "To verify eligibility for housing assistance (such as PMAY), what is your annual "
        "household income?",
    "age":
        "To check eligibility for the old-age pension scheme, could you please specify your "
        "current age?",
    "farmer_status_and_landholding":
        "To determine eligibility for PM-Kisan benefits, do you own cultivable agricultural "
        "land as a farmer?",
    "disability_status":
        "To check eligibility for disability welfare schemes, what is your certified benchmark "
        "disability percentage (e.g. 40% or above)?",
    "scheme_name_or_category":
        "Which government welfare scheme or category (e.g., housing, agriculture, pension, "
        "education) would you like to check eligibility for?",
}

# ---- screening rules: (rule, field, low exclusive, high inclusive, scheme, citation) ---------
SCREENING_RULES = [
    ("income-ews", "annual_income", None, 300000.0,
     "Pradhan Mantri Awas Yojana - Urban (PMAY-U) - CLSS EWS",
     "PMAY-U Guidelines 2024, Page 14"),
    ("land-holding", "landholding_hectares", 0.0, None,
     "PM-Kisan Samman Nidhi", "PM-Kisan Guidelines 2024, Page 4"),
]
