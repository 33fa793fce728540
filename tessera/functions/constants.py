"""Fixed values that results depend on.

Fixed values: these must equal the behaviour being reproduced, so they are
listed plainly, in natural order, in one place.
"""

# Invalid placeholder tokens (exact, case sensitive).
INVALID_TOKENS = ["", " ", "unknown", "UNKNOWN", "n/a", "N/A", "null", "NULL", "?", "--"]

# Junk written into numeric cells by the noise injectors.
NUMERIC_JUNK = ["unknown", "?", "n/a", ""]
TYPE_MISMATCH_TOKENS = ["N/A", "unknown", "#REF!", "TBD", "-"]

# Category aliases applied after strip + lower (the only one
# that changes anything is mty -> monterrey).
CATEGORY_ALIASES = {"mty": "monterrey"}

# Cleaning operations of the tool-based family.
TOOL_OPERATIONS = [
    "drop_duplicates",
    "replace_invalid_with_null",
    "cast_numeric",
    "cast_datetime",
    "impute_numeric",
    "impute_categorical",
    "normalize_categories",
    "clip_outliers_iqr",
]

# Cleaning operations of the domain family.
DOMAIN_OPERATIONS = ["fill_null", "fix_type", "remove_duplicate", "standardize", "trim", "correct_typo"]

# Tools accepted by the tool-call parser.
VALID_TOOLS = [
    "profile_data",
    "preview_data",
    "get_task_brief",
    "apply_cleaning_operation",
    "run_quality_gates",
    "submit_solution",
    "list_tasks",
]

# Reward constants.
TOOL_ERROR_REWARD = -0.2
STEP_IMPROVEMENT_MARGIN = 0.02
STEP_MAX_NEGATIVE = -0.15
GATE_BONUS_PASS = 0.15
GATE_BONUS_FAIL = -0.1
MIN_RETENTION = 0.85
DQ_DONE_THRESHOLD = 0.95
DQ_WEIGHTS = (0.40, 0.35, 0.25)  # completeness, consistency, uniqueness

# Labeling-function votes.
ABSTAIN, BAD, GOOD = -1, 0, 1

# Enrichment lookup tables.
INDUSTRY_BENCHMARK = {
    "Sales Executive": 65000,
    "Research Scientist": 72000,
    "Manager": 85000,
    "Lab Technician": 45000,
    "Manufacturing Director": 95000,
    "Healthcare Representative": 55000,
    "Human Resources": 60000,
}
INDUSTRY_CODE = {
    "Tech": "SIC-7372",
    "Healthcare": "SIC-8011",
    "Finance": "SIC-6020",
    "Retail": "SIC-5311",
    "Manufacturing": "SIC-3559",
}
INDUSTRY_CODE_DEFAULT = "SIC-9999"
ESCALATION_PATH = {
    "P1-Critical": "L3 -> Manager -> VP",
    "P2-High": "L2 -> L3 -> Manager",
    "P3-Medium": "L1 -> L2",
    "P4-Low": "L1",
}
STAGE_PROBABILITY = {
    "Prospecting": 0.10,
    "Qualification": 0.25,
    "Proposal": 0.50,
    "Negotiation": 0.75,
    "Won": 1.0,
    "Lost": 0.0,
}
PRIORITY_SEVERITY = {"P1-Critical": 1.0, "P2-High": 0.7, "P3-Medium": 0.4, "P4-Low": 0.1}
RECURRING_CATEGORIES = ["Network", "Email", "Access"]

# Enrichment sources per domain, in registry order.
ENRICHMENT_SOURCES = {
    "hr": ["salary_band", "tenure_risk", "satisfaction_index", "industry_benchmark", "flight_risk_score"],
    "sales": ["deal_size_category", "velocity_score", "win_probability_model", "industry_code", "competitive_risk"],
    "pm": ["schedule_risk_score", "resource_utilization", "dependency_chain_depth", "burndown_rate", "delay_probability"],
    "it_ops": ["sla_compliance_flag", "mttr_band", "escalation_path", "incident_severity_score", "recurring_pattern_flag"],
}

# Domain column lists (order matters: the first five form the
# duplicate key), numeric and categorical roles.
DOMAIN_COLUMNS = {
    "hr": ["EmployeeID", "Age", "Department", "JobRole", "MonthlyIncome", "YearsAtCompany", "Attrition",
           "JobSatisfaction", "OverTime", "DistanceFromHome", "Education", "PerformanceRating"],
    "sales": ["DealID", "AccountName", "Stage", "Amount", "CloseDate", "Rep", "Product", "Region", "LeadSource",
              "DaysInStage", "Probability", "ForecastCategory"],
    "pm": ["TaskID", "ProjectName", "Assignee", "Status", "Priority", "DueDate", "EstimatedHours", "ActualHours",
           "Dependencies", "Milestone", "RiskFlag", "CompletionPct"],
    "it_ops": ["TicketID", "Category", "Priority", "Status", "Assignee", "CreatedDate", "ResolvedDate", "SLATarget",
               "EscalationLevel", "AffectedSystem", "ResolutionType", "CustomerImpact"],
}
DOMAIN_NUMERIC = {
    "hr": ["Age", "MonthlyIncome", "YearsAtCompany", "DistanceFromHome"],
    "sales": ["Amount", "DaysInStage", "Probability"],
    "pm": ["EstimatedHours", "ActualHours", "CompletionPct"],
    "it_ops": ["SLATarget", "EscalationLevel"],
}
DOMAIN_CATEGORICAL = {
    "hr": ["Department", "JobRole", "Attrition", "OverTime"],
    "sales": ["Stage", "Region", "Product", "ForecastCategory"],
    "pm": ["Status", "Priority", "RiskFlag"],
    "it_ops": ["Category", "Priority", "Status", "ResolutionType"],
}

# Category values per domain column.
DOMAIN_CATEGORIES = {
    "hr": {
        "Department": ["Sales", "Research & Development", "Human Resources"],
        "JobRole": ["Sales Executive", "Research Scientist", "Manager", "Lab Technician",
                    "Manufacturing Director", "Healthcare Representative"],
        "Attrition": ["Yes", "No"],
        "OverTime": ["Yes", "No"],
    },
    "sales": {
        "Stage": ["Prospecting", "Qualification", "Proposal", "Negotiation", "Won", "Lost"],
        "Region": ["East", "West", "Central", "North", "South"],
        "Product": ["GTX Pro", "GTX Basic", "GTX Plus", "MG Special", "MG Advanced"],
        "ForecastCategory": ["Pipeline", "Best Case", "Commit", "Closed"],
    },
    "pm": {
        "Status": ["Not Started", "In Progress", "Completed", "On Hold", "Cancelled"],
        "Priority": ["Critical", "High", "Medium", "Low"],
        "RiskFlag": ["High", "Medium", "Low", "None"],
    },
    "it_ops": {
        "Category": ["Hardware", "Software", "Network", "Access", "Email"],
        "Priority": ["P1-Critical", "P2-High", "P3-Medium", "P4-Low"],
        "Status": ["Open", "In Progress", "Resolved", "Closed", "Pending"],
        "ResolutionType": ["Fix Applied", "Workaround", "No Fix", "Duplicate", "User Error"],
    },
}

# Labeling-function constants.
SALES_BAD_SPELLINGS = ["GTXPro", "GTXBasic", "GTXPlus", "MGSpecial", "MGAdvanced"]
VALID_IT_PRIORITIES = ["P1-Critical", "P2-High", "P3-Medium", "P4-Low"]

# Personas (name, role, style, keywords, anti-keywords).
PERSONAS = [
    {
        "name": "Executive",
        "role": "executive",
        "style": "strategic-financial",
        "keywords": ["revenue", "cost", "ROI", "risk", "trend", "quarter", "year-over-year", "impact", "budget",
                     "margin", "growth"],
        "anti_keywords": ["I think", "maybe", "um", "idk"],
    },
    {
        "name": "Manager",
        "role": "manager",
        "style": "operational-actionable",
        "keywords": ["team", "performance", "bottleneck", "capacity", "SLA", "process", "action", "priority",
                     "escalation", "delivery"],
        "anti_keywords": ["shareholder", "valuation", "IPO"],
    },
    {
        "name": "Individual Contributor",
        "role": "ic",
        "style": "plain-personal",
        "keywords": ["my", "I should", "next step", "deadline", "help", "understand", "priority", "task",
                     "assigned"],
        "anti_keywords": ["KPI", "ROI", "portfolio", "strategic", "EBITDA"],
    },
]

# Formality indicator words per language style.
FORMALITY_INDICATORS = {
    "strategic-financial": ["percent", "%", "million", "billion", "quarter", "fiscal", "forecast", "benchmark",
                            "metric"],
    "operational-actionable": ["action", "recommend", "should", "priority", "next steps", "immediate", "plan",
                               "schedule"],
}
