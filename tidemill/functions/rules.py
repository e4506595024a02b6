"""Rule tables. Everything here is data: fixed values that results depend on."""

from __future__ import annotations

# Role patterns, normalized role, seniority.
ROLES = [
    (r"vice[\s\-]*chair(?:person|man|)\b", "deputy_head", 90),
    (r"deputy\s+(?:hod|head\s+of\s+(?:the\s+)?department)\b", "deputy_head", 90),
    (r"associate\s+dean\b", "deputy_head", 90),
    (r"chair(?:person|man)\b", "head_of_department", 100),
    (r"\bhod\b", "head_of_department", 100),
    (r"head\s+of\s+(?:the\s+)?department\b", "head_of_department", 100),
    (r"\bdean\b", "dean", 95),
    (r"\bdirector\b", "director", 95),
    (r"\bprincipal\b", "principal", 95),
    (r"assistant\s+professor\b", "assistant_professor", 40),
    (r"associate\s+professor\b", "associate_professor", 50),
    (r"\bprofessor\s+emeritus\b", "professor_emeritus", 55),
    (r"\bprofessor\b", "professor", 60),
    (r"\blecturer\b", "lecturer", 30),
    (r"executive\s+assistant\b", "staff", 10),
    (r"\b(?:lab\s+)?technician\b", "staff", 10),
    (r"administrative\s+(?:officer|assistant)\b", "staff", 10),
]
HONORIFIC, LEADING_WINDOW = r"\b(?:dr|mr|mrs|ms|prof|shri|smt)\.?\s", 150

# Department spellings.
DEPARTMENT_ALIASES = {
    "eee": "electrical and electronics",
    "ece": "electronics and communication",
    "cse": "computer science",
    "cs": "computer science",
    "computer science and engineering": "computer science",
    "ai": "artificial intelligence",
    "aie": "artificial intelligence",
    "me": "mechanical",
    "mech": "mechanical",
    "ce": "civil",
}
DEPARTMENT_TAGS = {"computer science": "computing", "artificial intelligence": "computing"}
# Where a department's name ends, and what can't be one.
DEPARTMENT_STOP = [
    r"[,|;]", r"\bschool\s+of\b", r"\bprofile\s*:", r"\bqualification\s*:", r"\bemail\b", r"\bph\s*:",
]
CAMPUSES = ["bengaluru", "bangalore", "coimbatore", "chennai", "kochi", "mysuru", "nagercoil", "faridabad"]
DEPARTMENT_MAX_WORDS, DEPARTMENT_REJECT = 7, r"https?://|[:*]|\d{4}"

# Departments and their schools.
DEPARTMENT_SCHOOL = {
    "electronics and communication": "engineering",
    "ece": "engineering",
    "electrical and electronics": "engineering",
    "eee": "engineering",
    "electrical and computer": "engineering",
    "eac": "engineering",
    "mechanical": "engineering",
    "english": "engineering",
    "robotics": "engineering",
    "chemistry": "engineering",
    "physics": "engineering",
    "computer science and engineering": "computing",
    "computer science": "computing",
    "cse": "computing",
    "artificial intelligence and data science": "computing",
    "artificial intelligence": "computing",
    "data science": "computing",
    "computing": "computing",
    "aids": "computing",
    "ai": "computing",
    "aie": "computing",
    "business": "business",
}
SCHOOL_NAMES = {"engineering": "School of Engineering", "computing": "School of Computing", "business": "School of Business"}
# Words that tell a question's school; engineering's own come first.
ENGINEERING_WORDS = ["robotics", "mechanical", "electrical", "electronics", "civil", "english", "chemistry", "physics"]
COMPUTING_WORDS = ["artificial intelligence and data science", "computer science", "computing", "cse", "aids"]
COMPUTING_SCHOOLS = ["school of artificial intelligence", "school of computing"]

# Questions about people of a department, and about its head.
PEOPLE_WORDS = [
    "teacher", "teachers", "faculty", "professor", "professors", "lecturer", "lecturers",
    "staff", "researcher", "researchers", "scientist", "scientists",
]
PEOPLE_PHRASES = [r"who\s+(?:works?|work|teaches|teach|researches)", r"working\s+(?:on|in)", r"research\s+(?:interest|interests|area|areas)"]
HEAD_PHRASES = [r"head\s+of", r"who\s+heads", r"headed\s+by", r"in\s+charge\s+of"]

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "endsem": "end semester exam",
    "endsems": "end semester exam",
    "midsem": "mid semester exam",
    "midsems": "mid semester exam",
    "sem": "semester",
    "sems": "semesters",
    "reval": "revaluation",
    "cie": "continuous internal evaluation",
    "see": "semester end examination",
    "ese": "end semester examination",
    "prac": "practical",
    "practicals": "practical laboratory",
    "viva": "viva voce",
    "prof": "professor",
    "asst": "assistant",
    "assoc": "associate",
    "hod": "head of department",
    "vc": "vice chancellor",
    "dept": "department",
    "depts": "departments",
    "elig": "eligibility",
    "admn": "admission",
    "attd": "attendance",
    "att": "attendance",
    "ay": "academic year",
    "cgpa": "cumulative grade point average",
    "sgpa": "semester grade point average",
    "tt": "timetable",
    "sched": "schedule",
    "curric": "curriculum",
    "syll": "syllabus",
    "reg": "registration",
    "prereg": "pre-registration",
    "electives": "elective courses",
    "btech": "b tech bachelor of technology",
    "mtech": "m tech master of technology",
    "ug": "undergraduate",
    "pg": "postgraduate",
    "ece": "electronics and communication engineering",
    "eee": "electrical and electronics engineering",
    "cse": "computer science and engineering",
    "aie": "artificial intelligence engineering",
    "aids": "artificial intelligence and data science",
    "mech": "mechanical engineering",
    "civil": "civil engineering",
    "hostel": "hostel accommodation",
    "mess": "mess dining hall",
    "gym": "gymnasium fitness centre",
    "lib": "library",
    "admin": "administration",
    "placements": "placement recruitment",
    "internship": "internship training",
}

# Question categories, in order, and the keywords of some.
CATEGORIES = [
    "fees", "admissions_eligibility", "curriculum", "faculty", "placements", "hostel_campus_life",
    "achievements_research", "publications", "events", "facilities", "rankings_accreditation",
    "contact_info", "international_admissions", "general_info",
]
KEYWORDS = {
    "fees": ["fee", "fees", "tuition", "cost", "scholarship", "payment"],
    "admissions_eligibility": ["eligibility", "admission", "cutoff", "entrance", "apply", "jee"],
    "curriculum": ["curriculum", "syllabus", "subjects", "credits", "semester"],
    "faculty": ["faculty", "professor", "dr.", "hod", "chairperson", "principal"],
    "placements": ["placement", "package", "salary", "recruiter", "job"],
    "hostel_campus_life": ["hostel", "campus", "library", "mess", "accommodation"],
    "achievements_research": ["achievement", "award", "research", "publication", "paper"],
}
FALLBACK_CATEGORY = "general_info"

# What a follow-up question looks like.
FOLLOW_UP_WORDS = ["he", "him", "his", "she", "her", "hers", "they", "them", "their", "it", "its"]
FOLLOW_UP_STARTS = ["and", "also", "what about", "how about", "ok", "okay", "then", "so"]
FOLLOW_UP_ASKS = ["what", "who", "when", "where", "how", "why"]
FOLLOW_UP_REFERENCES = ["that one", "this one", "the same", "those", "these"]
FOLLOW_UP_TAIL = r"^\s*(?:and\s+)?(?:for|in|about|from)\s+[\w-]+(?:\s+[\w-]+){0,2}\s*\??$"
STANDALONE_WORDS = 3

# Phrases of an answer that declines.
DECLINES = [
    "don't have that information", "do not have that information", "don't have information",
    "do not have information", "doesn't have that information", "does not have that information",
    "does not state", "does not specify", "does not mention", "couldn't find", "could not find",
    "isn't in the", "is not in the", "no information about",
]

# Page parts that are no content, and months that start a list entry.
NOISE_TAGS = ["nav", "header", "footer"]
NOISE_CLASSES = ["mobile-menu-wrap", "secondary-nav", "tab_bar", "cnt-facility-wrap", "breadcrumb"]
NOISE_IDS = ["facilities-sec", "block-info"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

# Scoring profiles and thresholds.
PROFILES = {
    "web": {"abs_mid": 0.85, "abs_temp": 0.05, "sep_mid": 1.20, "sep_temp": 0.20, "use_sep": True},
    "upload": {"abs_mid": 0.06, "abs_temp": 0.10, "sep_mid": None, "sep_temp": None, "use_sep": False},
}
EPSILON, RANK_TEMP, FLOOR, SPAN = 1e-4, 0.05, 0.70, 0.30
HIGH, MEDIUM, ASSERT_AT, STORE_MARGIN = 0.70, 0.35, 0.30, 0.98
POOL, FILTERED_POOL, DEPARTMENT_POOL, TOP_K = 15, 50, 20, 5
MAX_CHARS, MIN_CHARS = 1200, 120
RATE_LIMIT, RATE_WINDOW, SEEN_IDS = 10, 3600, 2000
