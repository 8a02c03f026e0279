"""Word lists and tables that results depend on. Order matters where tests are in sequence."""

from __future__ import annotations

# Fixed values.
DEGREE_RANK = {"none": 0, "associate": 1, "bachelor": 2, "master": 3, "doctorate": 4, "unknown": -1}

# Fixed values; the first level with a marker in the text holds.
DEGREE_MARKERS = {
    "doctorate": ("phd", "ph.d", "doctorate", "doctoral", "md", "m.d", "juris doctor", "jd "),
    "master": ("master", "m.s", "ms ", "msc", "m.sc", "mba", "ma ", "m.a"),
    "bachelor": ("bachelor", "b.s", "bs ", "b.a", "ba ", "undergraduate"),
    "associate": ("associate", "community college"),
    "none": ("not required", "no degree", "none", "n/a"),
}

# Fixed values; the first domain with a marker in the text holds.
DOMAIN_MARKERS = {
    "cybersecurity": ("cybersecurity", "security", "threat", "malware", "fraud", "siem", "soc", "trust and safety"),
    "legal_compliance": ("legal", "compliance", "privacy", "regulatory", "contracts", "sanctions", "aml", "policy"),
    "finance_treasury": ("finance", "financial", "treasury", "banking", "payments", "accounting", "fp&a", "audit", "tax", "controller"),
    "hr_recruiting": ("recruit", "recruiting", "talent", "people ops", "human resources", "hr ", "sourcer"),
    "customer_support": ("customer support", "customer service", "customer success", "service recovery", "call center", "support quality", "support"),
    "marketing_growth": ("marketing", "growth", "brand", "content", "communications", "crm", "seo", "pr", "demand generation"),
    "sales_account_management": ("sales", "account executive", "account manager", "business development", "partnership", "partnerships", "acquisition", "revenue"),
    "product_program": ("product manager", "product management", "technical product manager", "program manager", "project manager", "tpm"),
    "data_ai": ("data scientist", "data science", "data analyst", "analytics", "machine learning", "ml ", " llm", "artificial intelligence", "business intelligence", "bi "),
    "design": ("design", "designer", "ux", "ui", "product design", "visual design"),
    "operations": ("operations", "strategy", "business analyst", "workforce", "wfm", "planning", "procurement", "logistics", "supply chain"),
    "software_engineering": ("software", "engineering", "engineer", "developer", "backend", "frontend", "full stack", "devops", "sre", "platform"),
}

# Names of an earlier scheme.
EARLIER_DOMAINS = {
    "software_internet": "software_engineering",
    "fintech": "finance_treasury",
    "healthcare_biotech": "operations",
    "ecommerce_retail": "operations",
    "education": "operations",
    "media_entertainment": "marketing_growth",
    "consulting_professional_services": "operations",
    "manufacturing_hardware": "operations",
    "logistics_supply_chain": "operations",
    "energy_climate": "operations",
    "government_public_sector": "operations",
    "nonprofit": "operations",
}

# Domains next to each other, either way.
DOMAIN_NEIGHBOURS = {
    "software_engineering": ("data_ai", "product_program"),
    "data_ai": ("software_engineering", "operations", "finance_treasury"),
    "product_program": ("software_engineering", "operations"),
    "finance_treasury": ("operations", "data_ai"),
    "operations": ("finance_treasury", "data_ai", "product_program", "marketing_growth"),
    "marketing_growth": ("sales_account_management", "operations"),
    "sales_account_management": ("marketing_growth",),
}

# Fixed values; the first level with a marker in the title holds.
SENIORITY_MARKERS = {
    "intern": ("intern", "internship"),
    "principal": ("principal", "staff", "architect"),
    "director": ("director", "head", "vice president", "vp", "chief"),
    "manager": ("manager", "mgr"),
    "lead": ("lead",),
    "senior": ("senior", "sr ", "sr.", "staff engineer"),
    "junior": ("junior", "jr ", "jr.", "associate", "coordinator", "assistant"),
}

# Fixed values.
SENIORITY_RANK = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "manager": 4, "director": 5, "principal": 5}

# What a posting says of sponsorship. "yes" means that it is not available.
SPONSORSHIP_EXACT = {"yes": ("yes", "y", "true", "1"), "no": ("no", "n", "false", "0")}
SPONSORSHIP_DENIED = (
    "no sponsorship", "not sponsor", "unable to sponsor", "unable to provide visa sponsorship", "without sponsorship",
    "sponsorship not available", "cannot sponsor", "visa sponsorship unavailable", "visa sponsorship is not provided",
    "sponsorship is not provided",
)
SPONSORSHIP_OFFERED = ("sponsorship available", "can sponsor", "visa sponsorship provided", "will sponsor")

# What a candidate says of work authorisation, need first.
NEEDS_SPONSORSHIP = ("need sponsorship", "requires sponsorship", "require sponsorship", "h1b", "opt", "visa required")

# Employment labels after canonical spelling.
EMPLOYMENT_EXACT = {
    "regular": "full-time", "fulltime": "full-time", "full time": "full-time", "parttime": "part-time",
    "part time": "part-time", "contract": "contract", "contractor": "contract", "per diem": "per-diem",
}
EMPLOYMENT_CONTAINS = {
    "intern": "intern", "apprentice": "apprenticeship", "volunteer": "volunteer", "third party": "contract",
    "contract": "contract", "fixed term": "temporary", "temporary": "temporary", "full time": "full-time",
    "part time": "part-time",
}

# Words that mark a line about experience.
EXPERIENCE_CONTEXT = ("experience", "experienced", "work experience", "relevant", "background")

# Fixed values of the weighted rerank.
WEIGHTS = {"cosine": 0.70, "skill": 0.15, "domain": 0.10, "seniority": 0.05}
REQUIRED_WEIGHT, PREFERRED_WEIGHT = 0.7, 0.3
EXPERIENCE_STEP, EXPERIENCE_MOST, EDUCATION_STEP, EDUCATION_MOST = 0.04, 0.12, 0.08, 0.08
TOP_K, TOP_N, MIN_COSINE = 200, 50, 0.48

# Words for regions, which name no country.
REGION_WORDS = (
    "remote", "global", "europe", "eu", "asia", "apac", "emea", "latam", "america", "americas", "north america",
    "south america", "africa", "anywhere",
)

# Codes of US states and Canadian provinces, which in a place text may mean these or a country.
AMBIGUOUS_ALPHA2 = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV",
    "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "PR",
    "AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT",
)
EXCEPTIONAL_ALPHA2 = {"UK": "GB"}

# Words that mark a line about education.
DEGREE_CONTEXT = (
    "degree", "bachelor", "master", "phd", "doctorate", "associate", "diploma", "undergraduate", "education",
    "qualification", "university", "college", "tertiary", "post-secondary", "4-year",
)

# What of a line about education tells a level, as substrings and as patterns.
DEGREE_LINE_MARKERS = {
    "associate": ("associate degree", "community college", "advanced diploma", "post-secondary diploma", "diploma"),
    "bachelor": ("bachelor", "b.a", "ba ", "b.s", "bs ", "undergraduate"),
    "master": ("master", "m.s", "ms ", "m.sc", "msc", "mba", "m.a", "ma "),
    "doctorate": ("doctorate", "doctoral", "phd", "ph.d", "m.d", "md ", "juris doctor"),
}
NO_DEGREE = r"(?i)\b(no degree|degree not required|no formal education|equivalent experience|experience in lieu of degree|degree optional)\b"
DEGREE_LINE_PATTERNS = {
    "bachelor": r"(?i)\b(bs/ms|ba/bs|bs/ba|bsc|b\.sc|4[-\s]?year degree|university degree|college degree|tertiary qualification|post[-\s]?secondary (?:education|qualification))\b",
    "master": r"(?i)\b(msc|m\.sc|meng|m\.eng|mba)\b",
}
BACHELOR_OR_MASTER = r"(?i)\b(?:ba|b\.a|bs|b\.s|bsc|b\.sc)\s*/\s*(?:ms|m\.s|msc|m\.sc|mba|meng|m\.eng)\b"

# Headings of a posting's sections, the first that fits holds; and which sections are kept, with how many lines.
SECTION_HEADINGS = {
    "role_summary": "the role|role overview|position summary|job summary|about the role|about this role|about the team|the opportunity",
    "responsibilities": "what you'll do|what you will do|responsibilities|your responsibilities|what you'll own|what you'll work on|key responsibilities",
    "requirements": "requirements|qualifications|minimum qualifications|basic qualifications|must have|must-have|what you bring|about you|who you are|what we're looking for|what we are looking for",
    "preferred": "nice to have|preferred qualifications|bonus points|preferred|good to have",
    "company": "about(?: .+)?|about us|about the company|who we are|company overview|company description",
    "benefits": "benefits|perks|why join us|what we offer|compensation|our benefits",
    "work_auth": "work authorization|visa|sponsorship|employment eligibility",
    "legal": "eeo statement|equal opportunity|privacy notice|legal notice",
    "apply": "how to apply|application process|interview process|next steps",
}
SECTION_LINES = {"role_summary": 2, "responsibilities": 5, "requirements": 5, "preferred": 2, "body": 3}
SECTION_TITLES = {
    "role_summary": "Role summary", "responsibilities": "Core responsibilities", "requirements": "Must-have evidence",
    "preferred": "Optional context", "body": "Additional role context",
}
DROPPED_LINES = (
    "equal opportunity employer", "equal opportunities employer", "all qualified applicants", "candidate privacy", "privacy notice", "visa sponsorship", "work authorization",
    "submit your application", "apply through", "medical, dental, and vision", "private health insurance", "disability insurance", "paid sick leave", "vacation days",
    "parental leave", r"401\(k\)", "commuter benefit", "quarterly offsites", "company social events", "inclusive workplace",
)
DOMAIN_HINTS = {
    "cybersecurity": ("fraud", "risk", "security", "abuse", "trust", "threat"),
    "software_engineering": ("backend", "platform", "api", "distributed systems", "service"),
    "data_ai": ("machine learning", "model", "analytics", "feature", "inference"),
}
ACTION_WORDS, ABILITY_WORDS = ("build", "design", "improve", "partner", "mentor"), ("experience", "strong", "ability", "familiarity")

# What ends a line of a text, and how a line names years of experience.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
YEARS = r"(?i)(\d{1,2})\s*(?:\+|plus)?\s*(?:[-–—to]{1,3}\s*\d{1,2})?\s+years?"
