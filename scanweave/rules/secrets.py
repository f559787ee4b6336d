"""Rules of the ``secrets`` domain, written from public token formats."""

_ALL = "all"
_CAT = "Secrets: Hardcoded Credentials"

# id, severity, category, name, OWASP class, CWE, suffixes or file names, pattern,
# cancelling pattern; a final True marks a rule on the file name.
SECRET_RULES = [
    ("SEC-001", "CRITICAL", _CAT, "Cloud Access Key Id", "A07:2021", "CWE-798", _ALL,
     r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", None),
    ("SEC-002", "CRITICAL", _CAT, "Private Key Block", "A07:2021", "CWE-321", _ALL,
     r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY", None),
    ("SEC-003", "CRITICAL", _CAT, "Source Host Access Token", "A07:2021", "CWE-798", _ALL,
     r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}\b|\bglpat-[A-Za-z0-9_\-]{20}", None),
    ("SEC-004", "CRITICAL", _CAT, "Chat Service Token", "A07:2021", "CWE-798", _ALL,
     r"\bxox[abprs]-[A-Za-z0-9\-]{10,}", None),
    ("SEC-005", "HIGH", _CAT, "JSON Web Token", "A07:2021", "CWE-522", _ALL,
     r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}", None),
    ("SEC-006", "CRITICAL", _CAT, "Credentials in URL", "A07:2021", "CWE-522", _ALL,
     r"[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@", r"://(user|username):(pass|password)@"),
    ("SEC-007", "HIGH", _CAT, "Quoted Secret Assignment", "A07:2021", "CWE-798", _ALL,
     r"""(password|passwd|secret|token|api_key|apikey)["\']?\s*[:=]\s*["\'][^"\'\s]{8,}["\']""",
     r"(example|placeholder|changeme|your[_\-])"),
    ("SEC-008", "HIGH", _CAT, "Payment Service Live Key", "A07:2021", "CWE-798", _ALL,
     r"\b(sk|rk)_live_[0-9a-zA-Z]{20,}", None),
    ("SEC-009", "HIGH", _CAT, "Browser API Key", "A07:2021", "CWE-798", _ALL,
     r"\bAIza[0-9A-Za-z_\-]{35}", None),
    ("SEC-010", "HIGH", "Secrets: Files", "Environment File Committed", "A05:2021", "CWE-538", _ALL,
     r"\.env(\.(local|dev|development|prod|production|staging))?$", None, True),
]
