"""Word lists, patterns, thresholds and tables that results depend on.

All values in this file are fixed; changing one changes results.
"""

from __future__ import annotations

# Topics and their keywords.
TOPICS = ["health", "finance", "work", "personal", "social", "legal", "travel", "education", "programming", "sports", "technology", "shopping", "family", "general"]
TOPIC_KEYWORDS = {
    "sports": [
        "basketball", "football", "soccer", "baseball", "tennis", "golf", "hockey", "game", "team", "player", "score", "match", "championship",
        "athlete", "winning", "overtime",
    ],
    "technology": [
        "smartphone", "computer", "laptop", "software", "hardware", "app", "processor", "camera", "device", "digital", "internet", "wifi",
    ],
    "shopping": [
        "bought", "purchased", "store", "mall", "sale", "discount", "price", "cart", "order", "delivery", "retail", "shop", "dress", "shoes",
        "clothes", "purchase",
    ],
    "health": [
        "doctor", "medicine", "prescription", "hospital", "treatment", "diagnosis", "symptom", "patient", "clinic", "nurse", "surgery", "antibiotic",
        "antibiotics", "prescribed", "infection", "therapy", "medical", "dental", "dentist", "fitness", "exercise", "diet", "wellness", "nutrition",
        "workout", "gym",
    ],
    "family": [
        "parents", "children", "kids", "siblings", "relatives", "grandparents", "cousins", "reunion", "mother", "father", "brother", "sister",
    ],
    "programming": [
        "code", "python", "javascript", "function", "class", "api", "debug", "compile", "algorithm", "def", "return", "import", "variable", "loop",
        "array", "programming", "coding", "developer", "quicksort", "recursion", "recursive", "select", "sql", "database", "query", "table",
        "insert",
    ],
    "finance": [
        "money", "budget", "investment", "bank", "savings", "loan", "credit", "tax",
    ],
    "education": [
        "school", "university", "college", "learning", "student", "teacher", "course", "study", "exam",
    ],
    "travel": [
        "vacation", "trip", "flight", "hotel", "destination", "airport", "tourism",
    ],
    "legal": [
        "lawyer", "court", "law", "contract", "attorney", "lawsuit", "legal",
    ],
    "work": [
        "job", "office", "meeting", "project", "deadline", "colleague", "boss", "career",
    ],
    "personal": [
        "diary", "journal", "thoughts", "feelings", "myself", "private", "personal", "reflection", "friends",
    ],
    "social": [
        "party", "socializing", "hangout", "gathering", "community", "networking", "social",
    ],
}

# Suffix rules of the light stemmer (suffix, replacement), first match wins.
STEM_RULES = [
    ("pping", "p"), ("tting", "t"), ("nning", "n"), ("mming", "m"), ("dding", "d"), ("gging", "g"), ("bing", "b"), ("ying", "y"), ("eing", "e"),
    ("uing", "ue"), ("oing", "o"), ("ting", "t"), ("ning", "n"), ("ming", "m"), ("king", "k"), ("ding", "d"), ("ring", "r"), ("ling", "l"),
    ("sing", "s"), ("zing", "z"), ("cing", "c"), ("ping", "p"), ("ing", ""), ("pped", "p"), ("tted", "t"), ("nned", "n"), ("mmed", "m"),
    ("dded", "d"), ("gged", "g"), ("bbed", "b"), ("ied", "y"), ("eed", "ee"), ("ued", "ue"), ("owed", "ow"), ("awed", "aw"), ("wed", "w"),
    ("ted", "t"), ("ned", "n"), ("med", "m"), ("ked", "k"), ("ded", "d"), ("red", "r"), ("led", "l"), ("sed", "s"), ("zed", "z"), ("ced", "c"),
    ("ped", "p"), ("ved", "ve"), ("ed", ""), ("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ses", "s"), ("oes", "o"),
    ("es", "e"), ("ss", "ss"), ("us", "us"), ("is", "is"), ("s", ""), ("ier", "y"), ("pper", "p"), ("tter", "t"), ("nner", "n"), ("mmer", "m"),
    ("dder", "d"), ("gger", "g"), ("bber", "b"), ("ler", "l"), ("ner", "n"), ("ter", "t"), ("ser", "s"), ("zer", "z"), ("cer", "c"), ("per", "p"),
    ("ker", "k"), ("der", "d"), ("er", ""), ("or", ""), ("ation", ""), ("ition", ""), ("ution", ""), ("tion", ""), ("sion", ""), ("ment", ""),
    ("iness", "y"), ("ness", ""), ("ily", "y"), ("ally", "al"), ("ly", ""), ("ful", ""), ("less", ""), ("able", ""), ("ible", ""), ("ity", ""),
    ("ative", ""), ("itive", ""), ("ive", ""), ("ious", ""), ("eous", ""), ("ous", ""), ("ical", "ic"), ("ual", ""), ("al", ""),
]

# Content types by pattern, later ones override earlier ones.
SOURCE_TYPES = {"chatgpt": "conversation", "readwise": "highlight", "github": "code", "notion": "note", "todoist": "list"}
CONVERSATION_PATTERNS = [r"\b(user|assistant|human|ai)\s*:", r"(?m)^(q:|a:|question:|answer:)", r"\[message\]|\[reply\]"]
CODE_PATTERNS = [r"```[\w]*\n", r"def\s+\w+\s*\(|function\s+\w+\s*\(|class\s+\w+", r"import\s+[\w.]+|from\s+[\w.]+\s+import"]
DOCUMENTATION_WORDS = ["documentation", "api reference", "getting started"]
MEETING_PATTERNS = [r"meeting\s+notes?|agenda|attendees|action\s+items", r"discussed|agreed|decided|next\s+steps"]
LIST_PATTERNS = [r"(?m)^\s*[-*]\s+\[[ x]\]", r"(?m)^\s*\d+\.\s+\w+"]
EMAIL_PATTERNS = [r"from:\s*\S+@\S+|to:\s*\S+@\S+|subject:", r"dear\s+\w+|regards,|sincerely,"]
DOMAIN_KEYWORDS = {
    "work": ["project", "deadline", "client", "meeting", "team", "report", "quarterly", "kpi", "revenue", "stakeholder", "deliverable", "sprint", "standup", "roadmap", "milestone"],
    "technical": ["code", "api", "database", "server", "deploy", "bug", "feature", "function", "class", "variable", "algorithm", "architecture", "docker", "kubernetes", "python", "javascript", "git"],
    "learning": ["learn", "study", "course", "tutorial", "lesson", "chapter", "concept", "understand", "example", "practice", "exercise"],
    "creative": ["idea", "story", "write", "draft", "creative", "inspiration", "brainstorm", "imagine", "design", "concept", "sketch"],
    "personal": ["journal", "diary", "today i", "feeling", "thought", "memory", "family", "friend", "weekend", "vacation", "birthday"],
    "finance": ["budget", "expense", "income", "investment", "savings", "tax", "payment", "invoice", "salary", "cost", "price", "money"],
}

# Extraction patterns.
DATE_PATTERNS = [
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\bQ[1-4]\s*\d{4}\b",
]
TIME_PATTERNS = [r"\b\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\b", r"\b\d{1,2}\s*(?:AM|PM|am|pm)\b"]
TEMPORAL_PATTERNS = [
    r"\b(?i:last|next|this|previous|upcoming)\s+(?i:week|month|year|quarter|day|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\b(?i:yesterday|today|tomorrow)\b",
    r"\b(?i:recently|soon|earlier|later)\b",
]
QUANTITY_PATTERNS = [
    r"\$[\d,]+(?:\.\d{2})?\s*(?:million|billion|M|B|K)?\b",
    r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:users|customers|employees|people|items|orders|requests|GB|MB|KB|TB|ms|seconds|minutes|hours|days|%|percent)\b",
    r"\b\d+(?:\.\d+)?[xX]\b",
]
ACTIVITY_PATTERNS = [
    r"\b(?i:deployed|released|launched|shipped|implemented|developed|built|created|designed|reviewed|analyzed|tested|fixed|updated|migrated|refactored|optimized|integrated|configured|monitored|debugged|resolved|completed|approved|merged|committed)\b",
    r"\b(?i:deploying|releasing|launching|shipping|implementing|developing|building|creating|designing|reviewing|analyzing|testing|fixing|updating|migrating|refactoring|optimizing|integrating|configuring|monitoring|debugging|resolving|completing|approving|merging|committing)\b",
]
TECHNOLOGIES = [
    "Python", "JavaScript", "TypeScript", "Java", "C++", "C#", "Go", "Rust", "Ruby", "PHP", "Swift", "Kotlin", "React", "Angular", "Vue", "Node.js",
    "Django", "Flask", "FastAPI", "Spring", "Rails", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Elasticsearch", "SQLite", "Docker", "Kubernetes",
    "AWS", "Azure", "GCP", "Terraform", "Ansible", "Git", "GitHub", "GitLab", "Jenkins", "TensorFlow", "PyTorch", "Keras", "REST", "GraphQL", "gRPC",
    "WebSocket", "HTTP", "API", "Linux", "Windows", "macOS", "Ubuntu", "OAuth", "JWT", "SSL", "TLS", "Kafka", "RabbitMQ", "Jira", "Slack",
]
TITLED_PERSON = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
TWO_NAMES = r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b"
ORGANIZATION = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Inc\.|Corp\.|LLC|Ltd\.|Co\.)"
CAMEL_TECH, SNAKE_TECH = r"\b[a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+)+\b"
CAMEL, SNAKE, CONSTANT, QUOTED = r"\b[a-z]+[A-Z][a-zA-Z]*\b", r"\b[a-z]+_[a-z_]+\b", r"\b[A-Z][A-Z_]{2,}\b", "[\"']([^\"']{2,30})[\"']"
KEY_SENTENCE_WORDS = ["important", "key", "main", "conclusion", "summary", "result", "finding", "therefore", "thus", "shows", "demonstrates", "reveals", "significant", "notably"]
KEY_CAMEL, KEY_SNAKE = r"\b[a-z]+[A-Z][a-zA-Z]*\b", r"\b[a-z]+_[a-z]+\b"

# Personal data, in the order in which equal spans are preferred.
PII_PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "PHONE": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "URL": r"https?://[^\s<>\"']+",
}

# Consent, file kinds, tiers.
CATEGORIES = ["personal", "financial", "health", "professional", "social", "technical", "general"]
FILE_KINDS = {
    "text": ["txt"],
    "markdown": ["md", "mdx"],
    "code": ["py", "js", "ts", "tsx", "jsx", "rs", "go", "java", "cpp", "c", "h", "hpp", "cs", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "yaml", "yml", "toml", "ini", "cfg", "conf", "xml", "html", "css", "scss", "sql"],
    "json": ["json"],
    "pdf": ["pdf"],
}
CODE_EXTENSIONS = [".py", ".js", ".java", ".cpp", ".c", ".go", ".rs", ".ts", ".tsx", ".jsx"]
LONG_EXTENSIONS = [".md", ".txt", ".rst", ".tex", ".html", ".xml"]
WIDE_EXTENSIONS = [".md", ".rst", ".tex", ".txt"]
TIER_LIMITS = {
    "base": {"max_documents": 1000, "max_chunks": 10_000, "dedup_threshold": 0.95, "memory_mb": 256, "gpu_memory_mb": 0, "concurrency": 1},
    "enhanced": {"max_documents": 5000, "max_chunks": 50_000, "dedup_threshold": 0.92, "memory_mb": 512, "gpu_memory_mb": 2048, "concurrency": 2},
    "advanced": {"max_documents": 20_000, "max_chunks": 200_000, "dedup_threshold": 0.90, "memory_mb": 1024, "gpu_memory_mb": 4096, "concurrency": 4},
    "full": {"max_documents": 100_000, "max_chunks": 1_000_000, "dedup_threshold": 0.88, "memory_mb": 2048, "gpu_memory_mb": 8192, "concurrency": 8},
}
PROMPT_PLAIN = "You are a helpful assistant with access to the user's personal knowledge base. Answer questions based on your knowledge."
PROMPT_HEAD = "You are a helpful assistant with access to the user's personal knowledge base. Use the following context to answer the user's question. If the context doesn't contain relevant information, say so.\n\nContext:\n"
PROMPT_TAIL = "\n\nNote: Some values in the context may have been modified for privacy protection."


def keyword_topics() -> dict[str, str]:
    return {w: t for t, ws in TOPIC_KEYWORDS.items() for w in ws}


def light_stem(word: str) -> str:
    """The light stemmer on one word; for building tables."""
    size = len(word.encode())
    if size > 3:
        for suffix, put in STEM_RULES:
            if size > len(suffix) + 1 and word.endswith(suffix):
                return word[: len(word) - len(suffix)] + put
    return word


def stem_topics() -> dict[str, str]:
    """Topic of each stem that differs from its keyword."""
    return {light_stem(w): t for w, t in keyword_topics().items() if light_stem(w) != w}
