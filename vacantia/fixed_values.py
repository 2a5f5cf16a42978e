"""Word lists, lookup tables, patterns and limits that decide results.

They are plain data in natural order, kept together here.
"""


# ---- seniority: (pattern, weight); each pattern counts once ---------------------
TIER_WEIGHTS = [
    (r"\b(?:chief|cto|ceo|cfo|vp|vice president|director)\b", 50),
    (r"\b(?:principal|distinguished|fellow)\b", 40),
    (r"\b(?:staff|lead|head of)\b", 30),
    (r"\b(?:senior|sr\.?)\b", 20),
    (r"\b(?:architect|manager)\b", 15),
    (r"\b(?:iii|iv|v|vi)\b", 15),
    (r"\blevel\s*[4-9]\b", 15),
    (r"\bengr?\s*[4-6]\b", 15),
    (r"\b(?:counsel|of\s*counsel)\b", 20),
    (r"\b(?:attending|charge)\b", 20),
    (r"\b(?:ii|2)\b", 5),
    (r"\blevel\s*3\b", 5),
    (r"\b(?:associate)\b", -10),
    (r"\b(?:junior|jr\.?)\b", -20),
    (r"\b(?:trainee|graduate|new\s*grad)\b", -25),
    (r"\bentry[\s-]?level\b", -25),
    (r"\b(?:i|1)\b(?!\s*-|\d)", -15),
    (r"\b(?:paralegal|clerk)\b", -15),
    (r"\b(?:resident|clinical\s*fellow)\b", -15),
    (r"\b(?:aide|assistant|tech)\b", -10),
    (r"\bintern(?:ship)?\b", -100),
]
# of each pattern: the words that match by themselves, and the words that begin a longer match, where the regex decides
TIER_WORDS = [
    ("chief cto ceo cfo vp director", "vice"), ("principal distinguished fellow", ""), ("staff lead", "head"), ("senior sr", ""),
    ("architect manager", ""), ("iii iv v vi", ""), ("level4 level5 level6 level7 level8 level9", "level"),
    ("eng4 eng5 eng6 engr4 engr5 engr6", "eng engr"), ("counsel ofcounsel", ""), ("attending charge", ""), ("ii 2", ""),
    ("level3", "level"), ("associate", ""), ("junior jr", ""), ("trainee graduate newgrad", "new"), ("entrylevel", "entry"),
    ("", "i 1"), ("paralegal clerk", ""), ("resident clinicalfellow", "clinical"), ("aide assistant tech", ""), ("intern internship", ""),
]
INTERN_AT_MOST, ENTRY_AT_MOST, SENIOR_AT_LEAST = -50, -5, 15

RECRUITER_TERMS = [
    "recruit", "recruiting", "recruiter", "staffing", "staff", "talent", "talenthub", "talentgroup",
    "solutions", "consulting", "placement", "search", "resources", "agency",
]

BLANK_TITLES = ["not specified", "n/a", "unknown"]

# ---- alert filter ---------------------------------------------------------------
TARGET_PHRASES = [
    "director of it", "director of it,", "director, it", "director, it,", "it director",
    "director of information technology", "director of enterprise it", "director of enterprise technology",
    "director of infrastructure", "infrastructure director", "director of technology infrastructure",
    "director of enterprise infrastructure", "director of cloud engineering",
    "director of cloud infrastructure", "director of compute", "director of server",
    "director of workplace technology", "director of end user services", "director of end user support",
    "director of service desk", "director of service delivery", "service delivery director",
    "director of managed services", "managed services director", "director of enterprise operations",
    "director of it operations", "director of technology operations", "director of platform operations",
    "director of production operations", "director of it service management",
    "director, it service management", "director of application support",
    "director of enterprise applications", "director of implementations", "director, implementations",
    "director of technology", "healthcare it director", "senior manager it", "senior manager of it",
    "senior manager, it", "senior manager infrastructure", "senior manager of infrastructure",
    "senior manager, infrastructure", "senior manager service delivery", "senior manager of service delivery",
    "senior manager, service delivery", "senior manager managed services",
    "senior manager of managed services", "senior manager, managed services",
    "senior manager technical operations", "senior manager of technical operations",
    "senior manager, technical operations", "senior manager server operations",
    "senior manager of server operations", "senior manager, server operations",
    "senior manager technical support", "senior manager of technical support",
    "senior manager, technical support", "senior manager itsm", "senior manager of itsm",
    "senior manager, itsm", "senior manager service desk", "senior manager of service desk",
    "senior manager, service desk", "senior technical support manager", "senior infrastructure manager",
    "senior service delivery manager", "senior it support manager", "senior it operations manager",
    "senior technology operations manager", "senior managed services manager", "senior itsm manager",
    "senior service desk manager", "technical support director", "manager of infrastructure operations",
    "infrastructure operations manager", "it operations manager", "technology operations manager",
    "systems operations manager", "it manager", "vp it", "vp of it", "vp infrastructure",
    "vp of infrastructure", "vp managed services", "vp of managed services", "vice president it",
    "vice president, it", "vice president infrastructure", "vice president of it",
    "vice president of infrastructure", "vice president managed services",
    "vice president of managed services", "head of it", "head of information technology",
    "head of infrastructure", "head of technology", "major incident manager",
    "technical implementation manager", "it implementation manager", "healthcare implementation manager",
    "ehr integration manager", "ehr implementation manager",
]

EXCLUSION_PHRASES = [
    "software engineer", "software developer", "software development", "frontend", "front-end", "front end",
    "backend", "back-end", "back end", "full stack", "fullstack", "full-stack", "data scientist",
    "data engineer", "data analyst", "machine learning", "ml engineer", "devops engineer",
    "site reliability engineer", "sre", "product manager", "program manager", "project manager", "intern",
    "internship", "entry level", "entry-level", "junior", "jr", "associate engineer", "staff engineer",
    "principal engineer", "alliances", "partnerships", "contracts and legal", "product owner", "oconus",
    "japan s6",
]

ALLOWED_LOCATIONS = [
    "remote", "jacksonville", " jax", ", florida", " florida",
    "anywhere", "work from home", "wfh",
]
ALLOWED_BARE_LOCATIONS = ["united states", "united states of america", "usa", "u.s.", "u.s.a."]
EXCLUDED_COUNTRIES = [
    "china", "india", "germany", "france", "spain", "italy", "brazil",
    "canada", "australia", "uk", "united kingdom", "england", "scotland",
    "wales", "netherlands", "sweden", "norway", "denmark", "singapore",
    "japan", "korea", "israel", "ireland", "poland", "mexico", "argentina",
    "colombia", "philippines", "portugal", "switzerland", "austria",
    "belgium", "flemish", "flanders", "wallonia",
    "czech", "hungary", "romania", "south africa", "nigeria", "kenya",
    "egypt", "uae", "pakistan", "latin america", "asia pacific", "apac",
    "- asia",
    "- phl", "- ind", "- chn", "- gbr", "- deu", "- fra", "- aus",
    "- bra", "- mex", "- sgp", "- jpn", "- kor", "- isr", "- irl",
    "phl -", "phl,", "ind -", "ind,",
    "ph - ",
    "- leeds", "- edinburgh", "- manchester", "- newcastle", "- glasgow",
    "- birmingham", "- sheffield", "- liverpool", "- bristol", "- london",
]
BLANK_LOCATIONS = ["", "not specified", "n/a", "unknown"]
ICIMS_INTL_PREFIXES = [
    "de-", "it-", "uk-", "fr-", "es-", "nl-", "au-", "ca-", "sg-", "jp-", "kr-", "in-", "br-", "mx-", "pl-",
    "se-",
]
WORKDAY_SEARCH_TERMS = ["director", "VP infrastructure", "head of IT", "incident manager"]

# ---- location parsing -----------------------------------------------------------
REMOTE_WORDS = ["remote", "anywhere", "worldwide", "work from home", "wfh"]
TIME_ZONE_WORDS = ["time zone", "timezone", "time zones", "timezones"]
GARBAGE_LOCATIONS = [
    "", "not specified", "n/a", "none", "tbd", "unspecified", "multiple locations", "various", "flexible",
    "other", "global", "multiple", "varies", "various locations", "2 locations", "3 locations", "4 locations",
    "5 locations", "6 locations", "7 locations", "8 locations", "9 locations", "10 locations",
]
WORK_PREFIXES = [
    "hybrid in ", "hybrid - ", "hybrid: ", "hybrid, ", "on-site in ", "on site in ",
    "onsite in ", "in-office in ", "in office in ", "based in ", "located in ",
]
WORD_EXPANSIONS = [
    ("n", "north"), ("s", "south"), ("e", "east"), ("w", "west"),
    ("nw", "northwest"), ("ne", "northeast"), ("sw", "southwest"), ("se", "southeast"),
    ("ft", "fort"), ("mt", "mount"), ("pt", "port"),
]
JUNK_WORDS = [
    "hq", "office", "headquarters", "hub", "campus", "location", "site", "center", "centre", "area",
    "township", "twp",
]

COUNTRY_ALIASES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US",
    "united states of america": "US", "america": "US", "can": "CA", "canada": "CA", "mx": "MX", "mex": "MX",
    "mexico": "MX", "gb": "GB", "gbr": "GB", "uk": "GB", "u.k.": "GB", "united kingdom": "GB",
    "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "britain": "GB",
    "great britain": "GB", "ie": "IE", "irl": "IE", "ireland": "IE", "deu": "DE", "ger": "DE",
    "germany": "DE", "deutschland": "DE", "fr": "FR", "fra": "FR", "france": "FR", "es": "ES", "esp": "ES",
    "spain": "ES", "it": "IT", "ita": "IT", "italy": "IT", "nl": "NL", "nld": "NL", "netherlands": "NL",
    "holland": "NL", "be": "BE", "bel": "BE", "belgium": "BE", "ch": "CH", "che": "CH", "switzerland": "CH",
    "at": "AT", "aut": "AT", "austria": "AT", "se": "SE", "swe": "SE", "sweden": "SE", "no": "NO",
    "nor": "NO", "norway": "NO", "dk": "DK", "dnk": "DK", "denmark": "DK", "fi": "FI", "fin": "FI",
    "finland": "FI", "pl": "PL", "pol": "PL", "poland": "PL", "pt": "PT", "prt": "PT", "portugal": "PT",
    "cz": "CZ", "cze": "CZ", "czech republic": "CZ", "czechia": "CZ", "gr": "GR", "grc": "GR", "greece": "GR",
    "ro": "RO", "rou": "RO", "romania": "RO", "ua": "UA", "ukr": "UA", "ukraine": "UA", "ind": "IN",
    "india": "IN", "cn": "CN", "chn": "CN", "china": "CN", "jp": "JP", "jpn": "JP", "japan": "JP", "kr": "KR",
    "kor": "KR", "korea": "KR", "south korea": "KR", "sg": "SG", "sgp": "SG", "singapore": "SG", "my": "MY",
    "mys": "MY", "malaysia": "MY", "ph": "PH", "phl": "PH", "philippines": "PH", "idn": "ID",
    "indonesia": "ID", "th": "TH", "tha": "TH", "thailand": "TH", "vn": "VN", "vnm": "VN", "vietnam": "VN",
    "hk": "HK", "hkg": "HK", "hong kong": "HK", "tw": "TW", "twn": "TW", "taiwan": "TW", "au": "AU",
    "aus": "AU", "australia": "AU", "nz": "NZ", "nzl": "NZ", "new zealand": "NZ", "isr": "IL", "israel": "IL",
    "ae": "AE", "are": "AE", "united arab emirates": "AE", "uae": "AE", "sau": "SA", "saudi arabia": "SA",
    "tr": "TR", "tur": "TR", "turkey": "TR", "za": "ZA", "zaf": "ZA", "south africa": "ZA", "eg": "EG",
    "egy": "EG", "egypt": "EG", "ng": "NG", "nga": "NG", "nigeria": "NG", "ke": "KE", "ken": "KE",
    "kenya": "KE", "br": "BR", "bra": "BR", "brazil": "BR", "brasil": "BR", "ar": "AR", "arg": "AR",
    "argentina": "AR", "cl": "CL", "chl": "CL", "chile": "CL", "col": "CO", "colombia": "CO", "pe": "PE",
    "per": "PE", "peru": "PE",
}

US_STATES = {
    "al": "AL", "alabama": "AL", "ak": "AK", "alaska": "AK", "az": "AZ", "arizona": "AZ", "ar": "AR",
    "arkansas": "AR", "ca": "CA", "california": "CA", "co": "CO", "colorado": "CO", "ct": "CT",
    "connecticut": "CT", "de": "DE", "delaware": "DE", "fl": "FL", "florida": "FL", "ga": "GA",
    "georgia": "GA", "hi": "HI", "hawaii": "HI", "id": "ID", "idaho": "ID", "il": "IL", "illinois": "IL",
    "in": "IN", "indiana": "IN", "ia": "IA", "iowa": "IA", "ks": "KS", "kansas": "KS", "ky": "KY",
    "kentucky": "KY", "la": "LA", "louisiana": "LA", "me": "ME", "maine": "ME", "md": "MD", "maryland": "MD",
    "ma": "MA", "massachusetts": "MA", "mi": "MI", "michigan": "MI", "mn": "MN", "minnesota": "MN",
    "ms": "MS", "mississippi": "MS", "mo": "MO", "missouri": "MO", "mt": "MT", "montana": "MT", "ne": "NE",
    "nebraska": "NE", "nv": "NV", "nevada": "NV", "nh": "NH", "new hampshire": "NH", "nj": "NJ",
    "new jersey": "NJ", "nm": "NM", "new mexico": "NM", "ny": "NY", "new york": "NY", "nc": "NC",
    "north carolina": "NC", "nd": "ND", "north dakota": "ND", "oh": "OH", "ohio": "OH", "ok": "OK",
    "oklahoma": "OK", "or": "OR", "oregon": "OR", "pa": "PA", "pennsylvania": "PA", "ri": "RI",
    "rhode island": "RI", "sc": "SC", "south carolina": "SC", "sd": "SD", "south dakota": "SD", "tn": "TN",
    "tennessee": "TN", "tx": "TX", "texas": "TX", "ut": "UT", "utah": "UT", "vt": "VT", "vermont": "VT",
    "va": "VA", "virginia": "VA", "wa": "WA", "washington": "WA", "wv": "WV", "west virginia": "WV",
    "wi": "WI", "wisconsin": "WI", "wy": "WY", "wyoming": "WY", "dc": "DC", "d c": "DC",
    "district of columbia": "DC", "washington dc": "DC", "washington d c": "DC",
}

CITY_ALIASES = {
    "bangalore": "bengaluru", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata",
    "peking": "beijing", "new york": "new york city", "nyc": "new york city", "ny city": "new york city",
    "nyc metro": "new york city", "ny metro": "new york city", "greater new york": "new york city",
    "new york metro": "new york city", "la": "los angeles", "la metro": "los angeles",
    "greater los angeles": "los angeles", "sf": "san francisco", "san fran": "san francisco",
    "bay area": "san francisco", "sf bay area": "san francisco", "san francisco bay area": "san francisco",
    "london city of": "london", "city of london": "london", "greater london": "london",
    "london metro": "london", "greater boston": "boston", "boston metro": "boston", "dc metro": "washington",
    "washington metro": "washington", "greater chicago": "chicago", "chicago metro": "chicago",
    "greater seattle": "seattle", "seattle metro": "seattle",
}
NYC_BOROUGHS = ["bronx", "brooklyn", "queens", "staten island", "manhattan"]
FAMOUS_CITIES = {
    "london": "GB", "paris": "FR", "san francisco": "US", "moscow": "RU", "berlin": "DE",
    "madrid": "ES", "rome": "IT", "sydney": "AU", "toronto": "CA", "dublin": "IE",
    "athens": "GR", "vienna": "AT", "cairo": "EG", "boston": "US", "chicago": "US",
    "seattle": "US", "denver": "US", "portland": "US", "columbus": "US", "richmond": "US",
    "springfield": "US",
}

# ---- page verification ----------------------------------------------------------
CLOSED_PHRASES = [
    "this job is no longer available", "job has been closed", "position has been filled",
    "no longer accepting applications", "requisition is closed", "job has been removed",
    "position is no longer available", "this opening has been filled", "this position has been filled",
    "job has expired", "posting has expired", "this job has expired", "job is no longer active",
    "no longer active", "position is closed", "not accepting applications", "job posting has been removed",
    "sorry, this job is no longer", "this opportunity is no longer", "job listing has been removed",
    "opening is no longer available", "the requested job could not be found",
    "job that you were looking for either does not exist or is no longer open",
    "page you are looking for doesn't exist", "page you are looking for does not exist",
    "this page no longer exists", "this job requisition is no longer open",
    "this requisition is no longer open", "404 - page not found", "page not found", "page cannot be found",
    "this page could not be found", "we couldn't find this page", "oops! the page", "oops, page not found",
]
# the older phrase list shares the first 21 entries
CLOSED_PHRASES_OLDER = [
    "this job is no longer available", "job has been closed", "position has been filled",
    "no longer accepting applications", "requisition is closed", "job has been removed",
    "position is no longer available", "this opening has been filled", "this position has been filled",
    "job has expired", "posting has expired", "this job has expired", "job is no longer active",
    "no longer active", "position is closed", "not accepting applications", "job posting has been removed",
    "sorry, this job is no longer", "this opportunity is no longer", "job listing has been removed",
    "opening is no longer available", "page you are looking for doesn't exist",
    "page you are looking for does not exist", "the page you requested was not found",
    "this page no longer exists", "oops! the page", "we couldn't find this page",
    "this job requisition is no longer open", "this requisition is no longer open", "404 - page not found",
    "error 404", "page cannot be found",
]
GENERIC_TITLES = [
    "", "greenhouse", "lever", "ashby", "bamboohr", "icims", "jobs", "careers", "job search",
    "job board", "error", "404", "page not found", "not found", "icims careers portal",
]
LATE_TITLE_HOSTS = ["icims.com", "bamboohr.com", "ashbyhq.com"]

SALARY_LABELS = [
    "salary", "compensation", "pay range", "base pay", "annual salary", "total compensation",
    "wage", "base salary", "salary range", "starting salary",
]
SALARY_LABELS_OLDER = [
    "salary", "compensation", "pay range", "base pay", "annual salary", "total compensation",
    "wage", "hourly rate", "base salary", "salary range",
]
SALARY_LOW, SALARY_HIGH = 25_000, 2_000_000
LABEL_BEFORE, LABEL_AFTER = 20, 400

MONTHS = [
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
]
DATE_FORMATS = [
    "MMMM d, y", "MMMM d y", "MMM d, y", "MMM d y", "d MMMM y", "d MMM y", "MMMM d,y",
]

STATE_CODES = list(dict.fromkeys(US_STATES.values()))
STATE_CODES_NOT_FL = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA",
    "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH",
    "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
STATE_NAMES_NOT_FL = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware",
    "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine",
    "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska",
    "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota",
    "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota",
    "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin",
    "wyoming", "district of columbia",
]
REMOTE_PAGE_WORDS = ["remote", "work from home", "wfh", "anywhere", "virtual"]
FOREIGN_PAGE_WORDS = [
    "canada", "uk", "united kingdom", "ireland", "australia", "india", "philippines",
    "germany", "france", "spain", "italy", "netherlands", "brazil", "mexico", "singapore",
    "japan", "south korea", "israel", "poland", "sweden", "denmark", "norway", "portugal",
    "switzerland", "austria", "belgium", "flemish", "flanders", "wallonia",
    "czech", "hungary", "romania", "south africa", "nigeria", "egypt", "uae", "pakistan",
    "lebanon", "colombia", "argentina", "new zealand", "taiwan", "vietnam", "thailand",
    "malaysia", "peru", "chile", "kenya", "ghana", "senegal", "uganda", "ethiopia",
    "england", "scotland", "wales", "northern ireland",
    "london", "leeds", "manchester", "edinburgh", "glasgow", "birmingham", "sheffield",
    "liverpool", "newcastle", "bristol", "yorkshire", "lancashire",
]
LOCATION_NOISE = [
    "filter", "search", "loading", "apply", "click", "submit", "all locations", "select", "type to",
]
COUNTRY_CODES = [
    "AF", "AL", "DZ", "AD", "AO", "AG", "AR", "AM", "AU", "AT", "AZ", "BS", "BH", "BD", "BB", "BY", "BE",
    "BZ", "BJ", "BT", "BO", "BA", "BW", "BR", "BN", "BG", "BF", "BI", "CV", "KH", "CM", "CF", "TD", "CL",
    "CN", "CO", "KM", "CD", "CG", "CR", "HR", "CU", "CY", "CZ", "DK", "DJ", "DM", "DO", "EC", "EG", "SV",
    "GQ", "ER", "EE", "SZ", "ET", "FJ", "FI", "FR", "GA", "GM", "GE", "DE", "GH", "GR", "GD", "GT", "GN",
    "GW", "GY", "HT", "HN", "HU", "IS", "IN", "ID", "IR", "IQ", "IE", "IL", "IT", "JM", "JP", "JO", "KZ",
    "KE", "KI", "KP", "KR", "KW", "KG", "LA", "LV", "LB", "LS", "LR", "LY", "LI", "LT", "LU", "MG", "MW",
    "MY", "MV", "ML", "MT", "MH", "MR", "MU", "MX", "FM", "MD", "MC", "MN", "ME", "MA", "MZ", "MM", "NA",
    "NR", "NP", "NL", "NZ", "NI", "NE", "NG", "MK", "NO", "OM", "PK", "PW", "PA", "PG", "PY", "PE", "PH",
    "PL", "PT", "QA", "RO", "RU", "RW", "KN", "LC", "VC", "WS", "SM", "ST", "SA", "SN", "RS", "SC", "SL",
    "SG", "SK", "SI", "SB", "SO", "ZA", "SS", "ES", "LK", "SD", "SR", "SE", "CH", "SY", "TW", "TJ", "TZ",
    "TH", "TL", "TG", "TO", "TT", "TN", "TR", "TM", "TV", "UG", "UA", "AE", "GB", "UK", "UY", "UZ", "VU",
    "VE", "VN", "YE", "ZM", "ZW",
]

# ---- limits and names -----------------------------------------------------------
CHUNK_ROWS = 25_000
RETENTION_DAYS = 30
PRUNE_DAYS = 30
NEW_BADGE_DAYS = 7
HEATMAP_MIN = 75
SAMPLE_URLS = 10
MIN_SALARY_SAMPLES = 5
HOURS_PER_YEAR = 2080
TOP_NEW = 20
PAGE_SIZES = (25, 50, 100)
ATS_NAMES = ["Greenhouse", "Ashby", "BambooHR", "Lever", "Workday", "iCIMS"]
BUILT_URL_ATS = ["Ashby", "BambooHR", "Workday"]
SOURCE_LABELS = "greenhouse_api, ashby_api, bamboohr_api, lever_api, workday_api, icims_sitemap"
STATUSES = ["saved", "applied", "ignored"]
WATCH_PLATFORMS = ["greenhouse", "lever", "workday"]

# fixed patterns: salaries in texts
RANGE_A_YEAR = r"(?i)\$\s*(\d{1,3}(?:,\d{3})*)\s*[k]?\s*[-–—]\s*\$?\s*(\d{1,3}(?:,\d{3})*)\s*[k]?\s*(?:a\s+year|per\s+year|annually|/year|/yr)\b"
SINGLE_A_YEAR = r"(?i)\$\s*(\d{1,3}(?:,\d{3})*)\s*[k]?\s*(?:a\s+year|per\s+year|annually|/year|/yr)\b"
DOLLARS = r"(?i)\$\s*(\d{1,3}(?:,\d{3})*|\d+)\s*[k]?\s*(?:[-–—]\s*\$?\s*(\d{1,3}(?:,\d{3})*|\d+)\s*[k]?)?"

# fixed patterns: dates in texts and pages
DAYS_AGO = r"(?i)(\d+)\s+days?\s+ago"
POSTED = r"(?i)posted(?:\s+on)?\s*[:\-]?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w{0,6}\.?\s+\d{1,2},?\s+\d{4})"
POSTED_ON_JSON = r'(?i)"postedOn"\s*:\s*"([^"]+)"'
TIME_TAG = r'(?i)<time[^>]+datetime="(\d{4}-\d{2}-\d{2})'

# fixed patterns: pages and their addresses
JSON_LD_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
WORKDAY_URL = r"(?i)^https://([^.]+)(\.wd\d+\.myworkdayjobs\.com)/([^/]+)/job/.+/[^_/]+_([A-Za-z0-9\-]+?)(?:/|\?|$)"
EMBED_SLUG = r"(?i)boards\.greenhouse\.io/embed/job_board(?:/js)?\?for=([a-z0-9\-_]+)"
HOME_MARKERS = r"remote[^<\n]{0,30}(?:yes|true|only)|\bwork from home\b"
ICIMS_CODE = r"(?i)\b([A-Z]{2})-([A-Z]{2})-\w+\b|\b([A-Z]{2})-[A-Za-z]+\b"
ICIMS_TITLE_PLACES = [
    r"(?i)[-–]\s*(Remote|Work from Home|Virtual|Anywhere|WFH)\s*(?:[-–|,]|$)",
    r"(?i)[-–]\s*((?:[A-Z][a-z]+(?:[\s\-][A-Z][a-z]+)*),\s*[A-Z]{2})\s*(?:[-–|,]|$)",
    r"(?i)[-–]\s*(United States|Nationwide|USA|U\.S\.A?\.?)\s*(?:[-–|,]|$)",
]
ICIMS_LABEL = r"(?i)\bLocation\b\s*[\n:]\s*([^\n]{3,100})"
# a cell ends at the closing tag of the element it starts with
ICIMS_CELLS = [
    r'(?is)data-field="formfield-C_Location"[^>]*>.*?<(span)[^>]*>(.*?)</\1>',
    r'(?is)class="[^"]*\biCIMS_TableBody\b[^"]*".*?<tr[^>]*>.*?<td[^>]*>.*?</td>\s*<(td)[^>]*>(.*?)</\1>',
    r'(?is)<(\w+)[^>]*class="[^"]*locationTitle[^"]*"[^>]*>(.*?)</\1>',
    r'(?is)<(\w+)[^>]*class="[^"]*jobLocation[^"]*"[^>]*>(.*?)</\1>',
    r'(?is)<(\w+)[^>]*class="[^"]*location-text[^"]*"[^>]*>(.*?)</\1>',
    r'(?is)<(\w+)[^>]*class="[^"]*\biCIMS_TableCell\b[^"]*"[^>]*>(.*?)</\1>',
]
ICIMS_ANYWHERE = (
    r"\b(?:Remote|Work from Home|WFH|Virtual|Nationwide|United States|Anywhere in (?:the )?U\.?S\.?A?\.?)\b"
    r"|(?:[A-Z][a-z]{2,}(?:[ \-][A-Z][a-z]+)*),\s*(?:" + "|".join(STATE_CODES) + r")\b"
)
