"""Fixed values of the data model.

These are contract values (calendar cut-offs, price lists, code lists, labels). Every
calendar value sits 24 years before the published one, so that it lines up with the
order dates of the input tables (1995-2001).
"""

from __future__ import annotations

# -- calendar -------------------------------------------------------------------------
TIMELINE_START = "1995-01-01"
TIMELINE_END = "2001-08-01"
SNAPSHOT = "2001-06-30"
CHANNEL_RENAME = "1998-06-01"
IDENTITY_MIGRATION = "1997-07-01"

# -- channels -------------------------------------------------------------------------
CHANNELS = ("d2c", "business_subscription", "marketplace")
CONSUMER_CHANNELS = ("d2c", "marketplace")
LEGACY_D2C_LABEL = "direct"
CHANNEL_LABELS = {
    "d2c": "Direct-to-Consumer",
    "business_subscription": "Business Subscriptions",
    "marketplace": "Marketplace",
}

# -- revenue --------------------------------------------------------------------------
MEASURES = ("gmv", "net_revenue", "recognized_revenue", "billed_revenue", "collected_cash")
PERSONA_MEASURE = {
    "Dana": "recognized_revenue",
    "Marcus": "gmv",
    "Priya": "billed_revenue",
    "Theo": "collected_cash",
    "Sam": "net_revenue",
}
DEFAULT_MEASURE = "recognized_revenue"
USD_TOLERANCE = 0.005
RATIO_TOLERANCE = 0.0001

# -- subscriptions --------------------------------------------------------------------
TERM_MONTHS = 12
NET_TERMS_DAYS = 30
CURRENT_GENERATION = 3
# plan_id, plan_name, generation, tier, launched, retired, annual price per seat,
# slot (0/1 splits a tier that sells two plans; None = the only plan of its tier)
PLANS = (
    ("starter_v1", "Business Starter", 1, "smb", "1995-01-01", "1997-06-30", 84.0, None),
    ("pro_v1", "Business Pro", 1, "enterprise", "1995-01-01", "1997-06-30", 156.0, None),
    ("team_v2", "Team", 2, "smb", "1997-07-01", "1999-03-31", 108.0, 0),
    ("office_v2", "Office", 2, "smb", "1997-07-01", "1999-03-31", 192.0, 1),
    ("enterprise_v2", "Enterprise", 2, "enterprise", "1997-07-01", "1999-03-31", 228.0, None),
    ("essentials", "Essentials", 3, "smb", "1999-04-01", None, 120.0, 0),
    ("growth", "Growth", 3, "smb", "1999-04-01", None, 204.0, 1),
    ("enterprise", "Enterprise", 3, "enterprise", "1999-04-01", None, 252.0, None),
)
PRICE_RISE_DATE = "2001-05-01"
PRICE_RISE_FACTOR = 1.12
# legacy plan -> the current plan of the same tier it would move to
MIGRATION_MAP = {
    "starter_v1": "essentials",
    "pro_v1": "enterprise",
    "team_v2": "essentials",
    "office_v2": "growth",
    "enterprise_v2": "enterprise",
}
SEGMENTS = ("smb", "enterprise")
GENERATIONS = (1, 2, 3)

# -- catalog and promotions -----------------------------------------------------------
# part type -> category; the position is also the supplier index of the category
CATEGORY_BY_PART_TYPE = {
    "ECONOMY": "paper",
    "SMALL": "writing",
    "MEDIUM": "office_tech",
    "PROMO": "furniture",
    "STANDARD": "breakroom",
    "LARGE": "storage",
}
CATEGORIES = tuple(CATEGORY_BY_PART_TYPE.values())
# code, name, first day, last day, discount, channels, attach rate in percent
PROMOTIONS = (
    ("WELCOME10", "Welcome 10", "1997-03-01", "1997-03-31", 0.10, "d2c", 35),
    ("SPRING5", "Spring Refresh", "1998-04-01", "1998-04-30", 0.05, "d2c,marketplace", 40),
    ("BTB15", "Back to Business", "2000-09-01", "2000-09-30", 0.15, "d2c,marketplace", 70),
)
STOCKOUT = ("1999-03-06", "1999-04-09")
PLATFORMS = ("google", "meta", "tiktok")

# -- support --------------------------------------------------------------------------
TICKET_CATEGORIES = ("shipping", "product", "billing", "account", "technical", "onboarding")

# -- identity -------------------------------------------------------------------------
# source system, raw table, id column
SOURCE_SYSTEMS = (
    ("app_db", "app_db__customers", "app_db_customer_id"),
    ("stripe", "stripe__customers", "stripe_customer_id"),
    ("shopify", "shopify__customers", "shopify_customer_id"),
    ("salesforce", "salesforce__customers", "salesforce_customer_id"),
)
STATUS_LABELS = {
    "resolved": "Resolved",
    "unresolved_migration_gap": "Unresolved — 2021 migration gap",
    "unresolved_sync_lag": "Unresolved — sync lag",
}
LINK_PRIMARY, LINK_MIGRATION, LINK_SYNC = "primary_key", "2021_migration", "direct_sync"

# -- dashboard periods: label -> trailing months (None = everything) -------------------
PERIODS = {"Last 6 Months": 6, "Last 12 Months": 12, "Last 24 Months": 24, "All Time": None}
CURRENT_WINDOW_MONTHS = 12

# -- text jobs ------------------------------------------------------------------------
STOP_WORDS = (
    "a an and are as at be by did do does for from how in is it its many much of on or our "
    "our that the their this to was we were what when which who why with you your"
).split()
MIN_INTEGER_GOLD = 1000
MIN_MONEY_GOLD = 100
INSTRUCTION_FILES = (
    "CLAUDE.md",
    "CLAUDE.local.md",
    "AGENTS.md",
    "AGENTS.override.md",
    "GEMINI.md",
    ".cursorrules",
    "copilot-instructions.md",
)
INSTRUCTION_DIRS = (".claude", ".codex", ".gemini", ".cursor", ".github")
FORBIDDEN_PATHS = (
    "*ground_truth*",
    "evals/*",
    "*/evals/*",
    "benchmarks/*",
    "*/benchmarks/*",
    "eval_harness/*",
    "*/eval_harness/*",
    "parity/*",
    "*/parity/*",
    "*measures.py",
)
