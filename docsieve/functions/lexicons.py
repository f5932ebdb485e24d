"""Our own lexicons: rules in order, for skills, certificates, titles, places and messages."""

from docsieve.functions.rules import Rules
from docsieve.operators.lexicon import Lexicon

#: Skills that are known by name: domain and category, in the order in which parts of names are looked for.
SKILLS = (
    ("python", "software", "languages"), ("javascript", "software", "languages"), ("typescript", "software", "languages"),
    ("sql", "data", "databases"), ("postgresql", "data", "databases"), ("spark", "data", "processing"), ("kubernetes", "software", "infrastructure"),
    ("docker", "software", "infrastructure"), ("react", "software", "frontend"), ("machine learning", "data", "models"), ("deep learning", "data", "models"),
    ("data analysis", "data", "analysis"), ("project management", "management", "delivery"), ("risk management", "management", "governance"),
    ("nursing", "health", "care"), ("patient care", "health", "care"), ("first aid", "health", "emergency"), ("budgeting", "finance", "planning"),
    ("excel", "finance", "tools"), ("teaching", "education", "classroom"), ("curriculum", "education", "design"), ("welding", "trades", "metal"),
    ("supply chain", "logistics", "planning"), ("go", "software", "languages"),
)
#: Sixteen domains and the categories of each; a phrase tells both.
DOMAINS = """
software/languages: python, java, javascript, js, typescript, go
software/frontend: react, native, css, browser
software/infrastructure: kubernetes, k8s, docker, cloud
data/models: machine learning, ml, deep learning, neural
data/databases: sql, postgresql, postgres, query
data/processing: spark, pyspark, pipeline
data/analysis: data analysis, data, statistic, dashboard
health/emergency: critical care, first aid, triage, ambulance
health/care: nursing, nurse, patient, care
health/practice: clinic, pharmacy, therapy, diagnosis
finance/planning: budgeting, budget, forecast, modelling
finance/accounts: accounting, ledger, bookkeeping
finance/tools: excel, spreadsheet, invoice
education/design: curriculum, syllabus, exam
education/classroom: teaching, teacher, lesson, pupil
trades/metal: welding, forging, lathe
trades/electric: electrical, electrician, wiring, fuse
trades/building: carpentry, masonry, plumbing
logistics/planning: supply chain, procurement, inventory
logistics/transport: freight, parcel, fleet
management/governance: risk management, compliance, policy
management/delivery: project, agile, scrum, milestone
management/people: operation, coaching, hiring
service/customers: customer service, customer, complaint
service/sales: sale, negotiation, pitch
service/stage: public speaking, presenting
law/courts: litigation, statute, contract
science/laboratory: assay, microscope, experiment
media/editing: copywriting, photography, newsroom
hospitality/kitchen: cooking, catering, reception
farming/fields: harvest, livestock, irrigation
security/guarding: patrol, surveillance, encryption
arts/studio: painting, sculpture, choreography
"""
DOMAIN_WORDS = Lexicon("domain_words", DOMAINS, "general")
DOMAIN_ALIASES = {"it": "software", "medicine": "health", "accounting": "finance", "school": "education"}
CATEGORY_ALIASES = {"programming": "languages", "db": "databases", "agile": "delivery"}
KNOWN_CATEGORIES = ("languages", "databases", "processing", "infrastructure", "models", "analysis", "delivery", "governance", "care", "planning")
TIER = Rules(
    [(r"\b(license|licence|registration)\b", "license"), (r"\b(bachelor|master|doctor|diploma|bsc|msc|phd|mba)\b", "education"), (r"\b(first aid|volunteer|mooc)\b", "voluntary"), (r"\b(certified|pmp|cka|chartered|certificate)\b", "certification")],
    "core_skill",
)
CERT_TIER = Rules([(r"\b(license|licence|registration|bachelor|master|doctor|diploma)\b", "professional"), (r"\b(pmp|project management professional|cka|chartered|aws)\b", "gold")], "voluntary")
ISSUERS = Lexicon(
    "issuers",
    """
    Cloud Native Computing Foundation: kubernetes, cka, ckad
    Project Management Institute: project management professional, pmp, capm
    Nursing Council: registered nurse, nursing license
    Amazon Web Services: aws
    Ministry of Education: teaching license, teacher license
    Welding Society: welding inspector, certified welding
    Red Cross: first aid, first responder
    Institute of Accountants: chartered accountant, accountant
    Ruling Body of Surveyors: chartered surveyor, surveyor
    Port Authority: forklift licence, crane operator
    University: bachelor, master, doctor, diploma
    """,
    "unknown",
)
#: Training comes first: who still learns isn't senior, but an experienced learner is more than a beginner.
TRAINING = Rules([(r"\b(apprentice(ship)?|cadet|intern(ship)?|learner|novice|student|trainee)\b", "training")], "regular")
SENIORITY = Rules(
    [(r"\b(experienced|senior)\b.*\b(apprentice|cadet|learner|trainee)\b", "senior"), (r"\b(apprentice|cadet|intern|learner|novice|student|trainee)\b", "entry"),
     (r"\b(board|chief|director|governor|president)\b", "director"), (r"\b(captain|foreman|head|lead|matron|staff)\b", "lead"), (r"\b(consulting|expert|senior|veteran)\b", "senior"),
     (r"\b(aide|assistant|helper|junior)\b", "junior")],
    "mid",
)
STAGE = Rules([(r"\b(intern|trainee|apprentice)\b", "in training"), (r"\b(chief|director)\b", "executive"), (r"\b(head|lead|manager)\b", "leadership"), (r"\b(senior|staff)\b", "advanced")], "practitioner")
RESUME_SENIORITY = Rules([(r"chief|director|executive", "executive"), (r"senior|lead|head|staff", "senior"), (r"intern|trainee|apprentice|junior", "junior")], "mid")
JD_SENIORITY = Rules([(r"\b(director|chief)\b|10\+ years", "director"), (r"\b(senior|lead)\b|5\+ years", "senior"), (r"\b(intern|trainee|graduate)\b", "entry")], "mid")
COUNTRIES = Lexicon(
    "countries",
    """
    Germany: berlin, hamburg, gmbh, meisterbrief
    United Kingdom: saint mary, london, leeds, ltd, a level
    United States: northwind, boston, chicago, llc, inc
    France: globex, lyon, paris, baccalaureat
    Ireland: blue river, dublin, cork
    Japan: osaka, tokyo
    India: mumbai, pune
    Kenya: nairobi, mombasa
    """,
    "unknown",
)
#: Four texts that tell a role's domain; they are asked apart and may differ.
ROLE_DOMAINS = {
    "by_title": Rules([("software|developer|data", "software"), ("nurse", "health"), ("teacher", "education"), ("electric", "trades"), ("manager|director|chief", "management")], "general"),
    "by_company": Rules([("hospital|health", "health"), ("college", "education"), ("parcel|ups", "logistics"), ("ibm|business machines|initech", "software")], "general"),
    "by_words": Rules([("engineer|developer", "engineering"), ("nurse|patient", "medicine"), ("analyst|analysis", "analytics")], "other"),
    "by_both": Rules([("nurse.*hospital|hospital.*nurse", "clinical"), ("engineer.*(ibm|initech)", "it services"), ("project", "projects")], "mixed"),
}
SKILL_KIND = Rules([(r"\b(python|java|javascript|typescript|js|ts|go|sql)\b", "language"), (r"\b(react|pyspark|spark)\b", "framework"), (r"\b(kubernetes|k8s|docker)\b", "infrastructure"), (r"\b(postgres|postgresql)\b", "database"), (r"\b(excel|microsoft)\b", "tool")], "other")
JD_DOMAINS = Rules([(r"python|java|software|docker", "software"), (r"sql|data|spark|learning", "data"), (r"nurs|patient|first aid", "health"), (r"budget|financ|excel", "finance"), (r"teach|curricul", "education"), (r"risk|project|agile", "management")], "general")
INTENT = Rules(
    [(r"\b(wrong|incorrect|mistake|never worked)\b", "correction"), (r"\b(missing|forgot|left out)\b", "missing"), (r"\b(too long|shorter|formal|tone)\b", "style"), (r"\b(again|regenerate|redo)\b", "regenerate"), (r"\b(thanks|great|perfect|love)\b", "praise"), (r"\b(bad|useless|terrible|hate)\b", "complaint"), (r"\?", "question")],
    "unclear",
)
INDUSTRY = Rules([("health|hospital", "health care"), ("college", "education"), ("parcel|ups", "transport"), ("ibm|machines|initech", "information technology"), ("trad", "trade")], "other")
INDUSTRY_LABELS = {"acme": "manufacturing", "globex inc": "energy"}
PROFESSION = Rules([("nurse", "nurse"), ("teacher", "teacher"), ("electric", "electrician"), ("engineer|developer", "engineer")], "other")
MESSAGES = (
    "This is wrong, I never worked there", "You forgot my \"Kubernetes\" project at Acme Corp", "Make it shorter please", "Please redo the summary", "Thanks, this is great", "ok",
    "This is terrible and useless", "Why is Python not listed?", "The tone is too formal for \"Northwind\"", "It left out my years with Blue River", "Nothing special to say here", "love it, perfect",
    "I was then promoted while also teaching at City College in Mar 2019 and May 2020 - 2021", "In Jan 2018 I moved to IBM, then in Feb 2019 to UPS, parallel to nursing, software design and quality work until Jul 2021",
)
INDUSTRIES = Lexicon(
    "industries",
    """
    software: python, java, javascript, typescript, docker, react, kubernetes, k8s
    data: sql, postgresql, spark, pyspark, machine learning, data analysis
    health: nursing, patient care, first aid, critical care
    finance: budgeting, financial modelling, excel
    logistics: supply chain, negotiation
    education: teaching, curriculum design, public speaking
    trades: welding, electrical wiring
    """,
    "unknown",
)
#: Words that tell what language a text is in, and that it speaks of rights.
COMMON_WORDS = Lexicon(
    "common_words",
    """
    english: the, and, that, with, from, this, they
    german: und, der, das, nicht, ist, mit der
    french: les, une, dans, pour, avec
    spanish: los, una, por, para, como
    rights: all rights reserved, license, copyright
    """,
    "other",
)
TECHNOLOGIES = Lexicon(
    "technologies",
    """
    language: python, java, javascript, typescript, js, ts, go, sql
    framework: react, react native, spark, apache spark, pyspark
    infrastructure: kubernetes, k8s, docker
    database: postgresql, postgres
    tool: excel, microsoft excel
    method: machine learning, deep learning
    """,
    "other",
)
# What makes a gap hard to close: words of trades under supervision, and the steps of a career, of our own choice.
SPECIAL_TERMS = ("inspection", "hazard", "tender", "clearance", "calibration")
LEVELS = ("apprentice", "trainee", "assistant", "engineer", "nurse", "manager", "head", "chief")
