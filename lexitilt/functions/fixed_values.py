"""Fixed values.

Word lists, lookup tables, constants and patterns that must hold exactly these
values for results to be right. They are data, stated once, and every operator
takes them as default parameters.

Patterns are written without verbose mode and without inline flags so that the
same text works in Spark (Java) and in any RE2 engine.
"""

# ---------------------------------------------------------------- fixed values
GROUP_ORDER = ["entry", "mid", "senior", "leadership"]

LEVEL_TO_SENIORITY = {
    "Internship": "entry",
    "Entry level": "entry",
    "Associate": "mid",
    "Mid-Senior level": "senior",
    "Director": "leadership",
    "Executive": "leadership",
}

DEGREE_LEVELS = {
    "phd": "doctorate",
    "doctorate": "doctorate",
    "mba": "masters",
    "m.tech": "masters",
    "mtech": "masters",
    "mca": "masters",
    "m.com": "masters",
    "mcom": "masters",
    "msc": "masters",
    "ms": "masters",
}

TOKEN_REPLACEMENTS = {
    "c++": "cplusplus",
    "c#": "csharp",
    ".net": "dotnet",
    "node.js": "nodejs",
    "react.js": "reactjs",
}

SHARE_GUARDRAILS = {
    "entry": (28, 38),
    "mid": (40, 50),
    "senior": (15, 23),
    "leadership": (4, 8),
}

TEXT_LENGTH_QUANTILES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]

LEAKAGE_WORDS = ["male", "female", "both", "years"]

NEIGHBOUR_WORDS = ["leadership", "manager", "collaboration", "python", "nurturing"]

SEEDS = [7, 17, 29]

# (documents below this, minimum count); the last value applies above
MIN_COUNT_STEPS = [(500, 1), (1500, 2), (5000, 3)]
MIN_COUNT_STEPS_SYNTHETIC = [(500, 1), (2000, 2), (5000, 3)]
MIN_COUNT_ABOVE = 5
SMALL_VOCABULARY = 5000

POSTING_COLUMNS = [
    "job_id",
    "company_id",
    "company_name",
    "title",
    "description",
    "skills_desc",
    "formatted_experience_level",
    "formatted_work_type",
    "location",
    "remote_allowed",
    "pay_period",
    "min_salary",
    "med_salary",
    "max_salary",
    "posting_domain",
    "listed_time",
    "original_listed_time",
]

DATE_COLUMNS = ["original_listed_time", "listed_time", "expiry", "closed_time"]

SYNTHETIC_COLUMNS = {
    "Job Title": "title",
    "Job Description": "description",
    "Experience": "experience",
    "Qualifications": "qualifications",
    "Responsibilities": "responsibilities",
    "Preference": "preference",
}

# Word association test: two target sets, two attribute sets.
WEAT_SPECS = {
    "gender_career_family": {
        "targets_a": ["he", "him", "his", "man", "male", "men", "boy", "father",
                      "brother", "son", "husband"],
        "targets_b": ["she", "her", "hers", "woman", "female", "women", "girl",
                      "mother", "sister", "daughter", "wife"],
        "attributes_a": ["career", "corporation", "salary", "office", "management",
                         "professional", "business", "promotion", "executive",
                         "leadership"],
        "attributes_b": ["home", "parents", "children", "family", "caring",
                         "support", "domestic", "marriage", "relatives",
                         "household"],
    }
}

WEAT_SPECS_SYNTHETIC = {
    "male_female_career_family": {
        "targets_a": [
            "he", "him", "his", "man", "male", "men", "boy", "boys",
            "father", "brother", "son", "uncle", "husband", "dad", "guy",
            "gentleman", "gentlemen", "king", "prince", "sir", "mr",
        ],
        "targets_b": [
            "she", "her", "hers", "woman", "female", "women", "girl", "girls",
            "mother", "sister", "daughter", "aunt", "wife", "mom", "lady",
            "ladies", "queen", "princess", "mrs", "ms",
        ],
        "attributes_a": [
            "career", "professional", "profession", "occupation", "job", "work",
            "office", "corporate", "industry", "business", "enterprise",
            "management", "manager", "leadership", "leader", "executive",
            "director", "authority", "command", "supervisor", "boss",
            "promotion", "salary", "income", "achievement", "success",
            "ambition", "competitive", "productivity", "responsibility",
            "strategy", "decision", "innovation", "performance",
        ],
        "attributes_b": [
            "family", "home", "household", "children", "child", "kids",
            "parent", "parents", "motherhood", "fatherhood",
            "marriage", "spouse", "relatives", "kin", "care",
            "support", "nurture", "nurturing", "caregiving",
            "domestic", "housework", "housekeeping",
            "dependents", "familycare",
        ],
    }
}

MASCULINE_CODED_WORDS = [
    "active", "ambitious", "analytical", "assertive", "competitive", "confident",
    "decisive", "driven", "independent", "leader", "leadership", "objective",
    "outspoken", "risk", "self_reliant", "superior",
]

FEMININE_CODED_WORDS = [
    "agreeable", "collaborative", "communal", "compassionate", "connect",
    "cooperative", "empathetic", "interpersonal", "kind", "loyal", "nurturing",
    "pleasant", "responsible", "supportive", "together", "understanding",
]

# Longer lists used on the synthetic postings (after Gaucher et al., 2011).
MASCULINE_CODED_WORDS_LONG = [
    "active", "adventurous", "aggressive", "ambitious", "analytical", "assertive",
    "athletic", "autonomous", "battle", "boast", "challenge", "champion",
    "competitive", "confident", "courageous", "decide", "decision", "decisive",
    "determine", "dominant", "driven", "fearless", "force", "headstrong",
    "independent", "individual", "intellectual", "lead", "leader", "leadership",
    "logic", "objective", "opinion", "outspoken", "persistent", "principled",
    "self_confident", "self_reliant", "strong", "superior", "strategic",
    "visionary", "directive", "authoritative", "command", "control",
    "results", "achievement", "ambition", "initiative", "risk", "win",
    "performance", "expert", "skilled", "specialist", "technical",
    "architect", "design", "build", "innovate", "optimize", "scale",
    "execute", "deliver", "ownership", "impact",
]

FEMININE_CODED_WORDS_LONG = [
    "agree", "affectionate", "collaborate", "commit", "communal", "compassionate",
    "connect", "considerate", "cooperate", "dependable", "emotional", "empathic",
    "feel", "gentle", "honest", "interpersonal", "kind", "loyal", "modest",
    "nurture", "pleasant", "polite", "quiet", "sensitive", "submissive",
    "support", "sympathetic", "tender", "together", "trust", "understand",
    "warm", "sharing", "helpful", "caring", "collaboration", "communication",
    "community", "team", "teamwork", "assist", "facilitate", "mentor",
    "guide", "encourage", "enable", "relationship", "inclusive",
    "cooperative", "partnership", "engagement", "listen", "respect",
    "responsive", "adaptable", "flexible", "approachable",
]


def _any_of(alternatives: list[str]) -> str:
    return r"\b(" + "|".join(alternatives) + r")\b"


# Whitespace as a Unicode-aware engine sees it; for use inside [...].
WS = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
STRIP_PATTERN = f"^[{WS}]+|[{WS}]+$"
# The same characters one by one.
WS_CHARACTERS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
                 "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
URL_PATTERN = rf"https?://[^{WS}]+|www\.[^{WS}]+"
BARE_URL_PATTERN = f"http[^{WS}]+"

# Tokens
LETTER_TOKEN_PATTERN = r"[a-z_]+"
TECH_TOKEN_PATTERN = r"\b[a-z][a-z0-9.+#_-]{1,}\b"

# Words that would leak the label or the form's structure into the vectors.
LEAKAGE_PATTERN = _any_of([
    "male", "female", "both", "to years", "years",
    "b com", "m com", "bba", "ba", "bs", "ms", "msc", "mba", "m tech", "b tech",
    "phd", "doctorate",
])

# Scope patterns. The description pattern holds its two-word terms without the
# space: that is what they match.
TECH_INDUSTRY_PATTERN = _any_of([
    "software", "information technology",
    r"technology,\s*information\s*and\s*(internet|media)",
    "it services", "computer", "data infrastructure", "cybersecurity",
    "telecommunications", "semiconductor", "internet",
])

CORE_DIGITAL_TITLE_PATTERN = _any_of([
    r"software\s+engineer", r"software\s+developer", r"application\s+developer",
    "developer",
    r"frontend\s+developer", r"front\s*end\s+developer",
    r"backend\s+developer", r"back\s*end\s+developer",
    r"full\s*stack\s+(engineer|developer)",
    r"web\s+developer", r"mobile\s+application\s+developer",
    r"ios\s+developer", r"android\s+developer",
    r"java\s+developer", r"python\s+developer", r"dotnet\s+developer",
    r"salesforce\s+developer",
    r"data\s+(scientist|engineer|analyst|architect|modeler)",
    r"machine\s+learning\s+engineer", r"ml\s+engineer", r"ai\s+engineer",
    r"computer\s+scientist",
    r"cloud\s+(engineer|architect)",
    r"devops\s+engineer", r"site\s+reliability\s+engineer", r"\bsre\b",
    r"platform\s+engineer",
    r"network\s+engineer", r"systems?\s+administrator", r"database\s+administrator",
    r"security\s+(engineer|analyst)", "cybersecurity", r"information\s+security",
    r"embedded\s+software\s+engineer", r"firmware\s+engineer",
    r"qa\s+engineer", r"quality\s+assurance\s+(engineer|specialist)",
    r"software\s+engineer\s+in\s+test", r"test\s+engineer", r"automation\s+engineer",
    r"solutions\s+architect", r"technical\s+product\s+manager",
])

_TECH_AREAS = ("(engineering|technology|data|security|it|software|platform|cloud|"
               "devops|product)")

TECH_LEADERSHIP_TITLE_PATTERN = _any_of([
    r"software\s+engineering\s+manager", r"engineering\s+manager",
    r"data\s+engineering\s+manager", r"platform\s+engineering\s+manager",
    r"information\s+security\s+manager", r"security\s+manager",
    r"it\s+manager", r"technology\s+manager",
    r"(director|head)\s+(of\s+)?" + _TECH_AREAS,
    _TECH_AREAS + r"\s+(director|head)",
    r"(vice\s+president|vp|chief)\s+(of\s+)?" + _TECH_AREAS,
])

AMBIGUOUS_TECH_TITLE_PATTERN = _any_of([
    r"product\s+manager", r"project\s+manager", r"program\s+manager",
    "architect", r"technical\s+lead", r"lead\s+developer", r"lead\s+engineer",
])

TECH_DESCRIPTION_PATTERN = _any_of([
    "software", "developer", "programming", "codebase", "api",
    "cloud", "dataplatform", "datapipeline", "machinelearning",
    "artificialintelligence",
    "networksecurity", "cybersecurity", "informationsecurity",
    "devops", "sitereliability", "database", "etl", "analyticsengineering",
    "java", "python", "javascript", r"c\+\+", "c#", "sql", "aws", "azure", "gcp",
    "react", "kubernetes",
])

NON_DIGITAL_ENGINEERING_PATTERN = _any_of([
    r"project\s+architect", r"building\s+engineer",
    "mechanical", "civil", "structural", "electrical", "industrial",
    "manufacturing",
    r"quality\s+engineer", r"process\s+engineer", "construction",
    r"field\s+service\s+technician", r"service\s+technician",
])

OFF_TARGET_ROLE_PATTERN = _any_of([
    r"data\s+entry", r"entry\s+clerk",
    r"sales\s+(associate|manager|supervisor|development)",
    r"account\s+(manager|executive)",
    r"customer\s+service", r"success\s+manager",
    r"executive\s+assistant", r"administrative\s+assistant",
    r"marketing\s+assistant",
    r"business\s+development", r"technical\s+writer", "retail",
])

# Seniority by title and platform level
ENTRY_TITLE_PATTERN = _any_of([
    "intern", "internship", "junior", r"jr\.?", "entry", r"new\s*grad", "graduate",
    "apprentice", "trainee",
])

LEADERSHIP_TITLE_PATTERN = _any_of([
    "chief", r"vice\s+president", r"\bvp\b", "director", r"head\s+of",
    r"engineering\s+manager", r"software\s+engineering\s+manager",
    r"data\s+engineering\s+manager", r"product\s+manager", r"project\s+manager",
    r"program\s+manager",
    r"it\s+manager", r"technology\s+manager", r"security\s+manager",
    r"information\s+security\s+manager",
])

SENIOR_TITLE_PATTERN = _any_of(["senior", r"sr\.?", "principal", "staff", "lead"])

# Titles that contradict a platform level (matched without regard to case)
NOISY_ENTRY_TITLE_PATTERN = _any_of(
    ["intern", "junior", r"jr\.?", "entry", "graduate", r"new\s*grad"])
NOISY_LEADERSHIP_TITLE_PATTERN = _any_of(
    ["chief", r"vice\s+president", r"\bvp\b", "director", r"head\s+of"])
NOISY_SENIOR_TITLE_PATTERN = _any_of(["senior", r"sr\.?", "principal", "staff", "lead"])

NOISY_BUCKETS = {
    "entry_title_not_entry": (
        NOISY_ENTRY_TITLE_PATTERN, ["Entry level", "Internship"]),
    "leadership_title_not_leadership": (
        NOISY_LEADERSHIP_TITLE_PATTERN, ["Director", "Executive"]),
    "senior_title_not_seniorish": (
        NOISY_SENIOR_TITLE_PATTERN, ["Mid-Senior level", "Director", "Executive"]),
}

# Seniority from title, text, experience and degree
EXEC_TITLE_PATTERN = _any_of([
    r"chief\s+.*officer", "cto", "cfo", "coo", "ciso",
    r"vice\s+president", r"vp\b", r"vp\s+of",
    r"executive\s+director", r"head\s+of",
    "president", r"general\s+manager",
    "founder", "cofounder", "owner", "partner",
])
DIRECTOR_PATTERN = r"\bdirector\b"
EARLY_CAREER_PATTERN = _any_of([
    "intern", "internship", "junior", r"jr\.?", r"entry[-\s]*level",
    r"new\s*grad", "graduate", "trainee", "apprentice",
])
SENIOR_MARK_PATTERN = _any_of([
    "senior", r"sr\.?", "principal", "staff", "architect",
    r"lead\s+engineer", r"lead\s+developer", r"team\s+lead", r"tech\s+lead",
    "consultant", "expert",
])
MANAGER_PATTERN = r"\b(manager|supervisor)\b"
LOWERING_PATTERN = r"\b(assistant|associate|junior|jr\.?|trainee)\b"
LEADERSHIP_DUTY_PATTERN = _any_of([
    r"manage\s+teams?", r"lead\s+teams?", r"oversee\s+operations?",
    r"strategic\s+planning", r"budget\s+management", r"drive\s+strategy",
    r"organizational\s+leadership",
])
SENIOR_DUTY_PATTERN = _any_of([
    "mentor", r"own\s+projects?", r"architecture\s+design",
    r"technical\s+leadership", r"complex\s+systems?", r"cross[-\s]?functional",
])
ARCHITECT_PATTERN = r"\barchitect\b"
DATA_RESEARCH_TITLE_PATTERN = _any_of([
    "data", "analytics?", "analyst", "analysis", "research", "scientist",
    r"machine\s+learning", "ml", "ai", r"business\s+intelligence", "bi",
    "statistic", "quant",
])
TECH_TITLE_INCLUDE_PATTERN = _any_of([
    "software", "dev", "developer", "programmer", "data",
    r"machine\s+learning", "ml", "ai", r"artificial\s+intelligence",
    "cloud", "devops", "sre", r"site\s+reliability",
    "security", "cyber", "network", "database",
    "backend", r"back[-\s]*end", "frontend", r"front[-\s]*end", r"full[-\s]*stack",
    "qa", r"quality\s+assurance", r"test\w*",
    "it", r"information\s+technology", r"systems?\s+administrator",
    "ui", "ux", "web", "mobile", "ios", "android",
    r"product\s+manager", r"technical\s+product\s+manager",
    r"business\s+intelligence", "bi", "platform", "automation", "architect",
])
TECH_TITLE_EXCLUDE_PATTERN = _any_of([
    "marketing", "sales", "finance", "financial", "investment",
    "account", "accountant", "legal", "attorney",
    "nurse", "physician", "therapist", "dental", "veterinarian", "teacher",
    "procurement", r"supply\s+chain", r"customer\s+service",
    "hr", r"human\s+resources", "event", "wedding",
    r"landscape\s+architect", r"civil\s+engineer", r"mechanical\s+engineer",
])
EXPERIENCE_RANGE_PATTERN = r"(\d+)\s*(?:to|-)\s*(\d+)\s*years?"
EXPERIENCE_SINGLE_PATTERN = r"(\d+)\s*years?"

# Points of the scored seniority rule
SCORE_TITLE_SENIOR = 4.0
SCORE_TITLE_MANAGER = 2.0
SCORE_TEXT_DUTY = 1.0
SCORE_TEXT_SENIOR = 1.5
SCORE_TEXT_MANAGER = 0.75
SCORE_TEXT_EARLY = -2.0
SCORE_YEARS = [(8, 3.0), (5, 2.5), (3, 1.0)]
SCORE_DEGREES = {"doctorate": 1.0, "masters": 0.5}
SCORE_SENIOR_FROM = 2.5
SCORE_ENTRY_UPTO = -2.0
# ------------------------------------------------------------ end of fixed values
