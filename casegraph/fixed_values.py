"""Word lists, lookup tables, patterns and limits that decide results.

They are facts of the data model, kept together so that every operator (and every
reader) finds them in one place.
"""

# Whitespace removed at both ends of a value.
WHITESPACE = (
    " \t\n\r\f\x0b\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Ordered enumerations: name -> rank.
ACTIVITY_MODES = {"passive": 0, "active": 1, "aggressive": 2}
SEVERITIES = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

# Categories that become entities.
ENTITY_CATEGORIES = [
    "author", "last_saved_by", "email", "username", "hostname", "server", "domain",
    "url", "application", "company", "manager", "printer", "path", "unc_path", "gps",
]

# Categories whose values are pseudonymized in redacted reports.
SENSITIVE_CATEGORIES = [
    "author", "last_saved_by", "email", "username", "hostname", "server", "domain", "url",
    "path", "unc_path", "gps", "password", "credential", "credential_indicator", "manager",
]

# Categories compared in lower case.
LOWERED_CATEGORIES = ["email", "hostname", "server", "url"]

# Text keys -> category (anything with "printer" -> printer, else config.<key>).
TEXT_KEYS = {
    "full address": "server", "address": "server", "server": "server", "tcpbrowseraddress": "server",
    "gatewayhostname": "server", "sslproxyhost": "server", "httpbrowseraddress": "server",
    "username": "username", "user name": "username", "usernamehint": "username",
    "domain": "domain",
    "clientname": "hostname", "hostname": "hostname",
    "password": "credential_indicator", "password 51": "credential_indicator",
    "passwordscrambled": "credential_indicator", "clearpassword": "credential_indicator",
    "alternate shell": "application", "remoteapplicationprogram": "application",
    "initialprogram": "application",
    "clientdirectory": "path", "workdirectory": "path",
}

# Office property elements (compared without case) -> category.
OFFICE_ELEMENTS = {
    "creator": "author", "lastModifiedBy": "last_saved_by", "created": "date", "modified": "date",
    "lastPrinted": "date", "revision": "revision", "title": "title", "subject": "subject",
    "description": "comments", "keywords": "keywords", "Application": "application",
    "AppVersion": "application_version", "Company": "company", "Manager": "manager",
    "generator": "application", "editing-duration": "editing_duration", "editing-cycles": "revision",
    "initial-creator": "author", "printed-by": "last_saved_by", "creator-tool": "application",
    "language": "language", "template": "path", "date-time": "date", "comment": "comments",
}

# XMP property (lower case) -> category, else xmp.<property>.
XMP_PROPERTIES = {
    "creator": "author", "author": "author",
    "creatortool": "application", "producer": "application", "softwareagent": "application",
    "createdate": "date", "creationdate": "date", "modifydate": "date", "moddate": "date",
    "metadatadate": "date", "when": "date",
    "title": "title", "description": "comments", "subject": "subject",
    "lasturl": "path", "manager": "path",
    "documentancestors": "document_ancestor",
    "action": "history.action", "changed": "history.changed",
    "instanceid": "document_id", "originaldocumentid": "document_id", "documentid": "document_id",
    "nickname": "embedded_object",
}

# The shorter XMP table of the plain string scan.
XMP_STRING_PROPERTIES = {
    "creator": "author", "author": "author", "creatortool": "application", "producer": "application",
    "createdate": "date", "modifydate": "date", "metadatadate": "date",
    "title": "title", "description": "comments",
}

# RDF/XMP wrappers skipped when looking for the property an item belongs to (lower case).
RDF_WRAPPERS = ["rdf", "description", "seq", "bag", "alt", "li", "xmpmeta"]

# Image tag name rules, first hit wins, compared without case; else image.<tag>.
IMAGE_TAG_RULES = [
    ("gps", "gps"), ("latitude", "gps"), ("longitude", "gps"),
    ("date", "date"), ("time", "date"),
    ("software", "application"),
    ("artist", "author"), ("creator", "author"),
    ("host computer", "hostname"), ("operating system", "operating_system"),
    ("model", "device_model"), ("copyright", "copyright"),
]

# Custom document property (slug) -> category, else custom.<slug>.
CUSTOM_PROPERTIES = {
    "author": "author", "creator": "author", "company": "company", "manager": "manager",
    "application": "application", "software": "application",
    "path": "path", "filepath": "path", "file_path": "path",
    "title": "title", "comments": "comments", "description": "comments",
}

# PDF Info keys in output order -> category, and file-specification keys.
PDF_INFO_KEYS = {
    "Author": "author", "Creator": "application", "Producer": "application",
    "CreationDate": "date", "ModDate": "date", "Subject": "subject", "Title": "title",
    "Keywords": "keywords", "Trapped": "pdf.trapped",
}
PDF_FILE_KEYS = {"UF": "embedded_object", "F": "embedded_object", "Desc": "comments"}

# Families of the differential comparison: family -> categories ("history*" = prefix).
CATEGORY_FAMILIES = {
    "users": ["author", "last_saved_by", "username", "manager", "history.author"],
    "applications": ["application"],
    "emails": ["email"],
    "paths": ["path", "unc_path", "url"],
    "servers": ["server", "hostname"],
    "printers": ["printer"],
    "password_indicators": ["password", "credential", "credential_indicator"],
    "history": ["history*"],
    "old_versions": ["old_version"],
    "title": ["title"],
    "company": ["company"],
    "operating_system": ["operating_system"],
    "gps": ["gps"],
}

# Leading bytes (hex) -> (kind, mime type), in order.
MAGIC_NUMBERS = [
    ("255044462D", "pdf", "application/pdf"),
    ("D0CF11E0A1B11AE1", "ole_compound", "application/x-ole-storage"),
    ("FF575043", "word_perfect", "application/vnd.wordperfect"),
    ("0606EDF5D81D46E5BD31EFE7FE74B71D", "in_design", "application/x-indesign"),
    ("89504E470D0A1A0A", "image", "image/png"),
    ("FFD8FF", "image", "image/jpeg"),
    ("49492A00", "image", "image/tiff"),
    ("4D4D002A", "image", "image/tiff"),
]
CONTAINER_MIME_TYPES = {
    "open_xml": "application/vnd.openxmlformats-officedocument", "open_document": "application/vnd.oasis.opendocument",
    "zip": "application/zip",
}
ZIP_MAGIC = ["504B0304", "504B0506"]

# Extension fallback when no magic number matches.
FALLBACK_EXTENSIONS = {
    "rdp": ("rdp", "application/x-rdp"),
    "ica": ("ica", "application/x-ica"),
    "indd": ("in_design", "application/x-indesign"),
    "wpd": ("word_perfect", "application/vnd.wordperfect"),
}

# Extension -> expected kind, for the mismatch check.
EXTENSION_KINDS = {
    "doc": "ole_compound", "xls": "ole_compound", "ppt": "ole_compound",
    "docx": "open_xml", "xlsx": "open_xml", "pptx": "open_xml",
    "odt": "open_document", "ods": "open_document", "odp": "open_document",
    "pdf": "pdf", "svg": "svg", "rdp": "rdp", "ica": "ica", "indd": "in_design", "wpd": "word_perfect",
    "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "tif": "image", "tiff": "image",
    "webp": "image",
}

# Non-public IPv4 prefixes and IPv6 prefixes.
NON_PUBLIC_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
    "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/3",
]
NON_PUBLIC_V6 = [
    "::/128", "::1/128", "fe80::/10", "fec0::/10", "ff00::/8", "fc00::/7", "2001:db8::/32",
]

# Endpoint URI scheme -> (protocol, dns mode).
ENDPOINT_SCHEMES = {
    "http": ("http", "local"), "https": ("https_connect", "local"), "socks4": ("socks4", "local"),
    "socks5": ("socks5", "local"), "socks5h": ("socks5_host", "remote"),
}

# Outcomes that send an endpoint to cooldown and count against a provider.
ROTATING_OUTCOMES = [
    "timeout", "dns_failure", "connect_failure", "tls_failure", "proxy_authentication_required",
    "forbidden", "rate_limited", "server_error", "challenge",
]
UNUSABLE_ENDPOINT_STATUS = ["disabled", "quarantined", "unavailable"]
EWMA_KEEP, EWMA_NEW = 0.8, 0.2
COOLDOWN_SECONDS = 120
LEASE_TTL_SECONDS = 900
CIRCUIT_ENDPOINTS = 3

# Byte order marks of text, in hexadecimal.
BYTE_ORDER_MARKS = ["EFBBBF", "FFFE", "FEFF", "0000FEFF"]

# HTTP body markers.
CHALLENGE_MARKERS = ["captcha", "challenge-platform"]
TECHNOLOGY_MARKERS = [("wp-content", "WordPress"), ("__next", "Next.js"), ("drupal", "Drupal")]

# Backup suffixes and root candidates.
BACKUP_SUFFIXES = ["~", ".bak", ".old", ".orig", ".save", ".zip"]
BACKUP_ROOT_FILES = ["backup.zip", "www.tar.gz"]

LABEL_PATTERN = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"

# Word characters as in the .NET definition of \w.
WORD = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
EMAIL = rf"(?<![{WORD}.+-])[{WORD}.+-]+@[{WORD}.-]+\.[A-Za-z]{{2,}}(?![{WORD}.-])"
# A match starts where the last one ended or where a run of local characters starts: the plain pattern's matches, in
# linear time.
EMAIL_UNGUARDED = rf"(?:\G|(?<![{WORD}.+-]))[{WORD}.+-]++@[{WORD}.-]+\.[A-Za-z]{{2,}}"
UNC_PATH = r"\\\\[A-Za-z0-9._-]+\\[^\x00-\x1f\s]+"
URL = r"""(?i)https?://[^\x00-\x20<>"']{3,}"""
WINDOWS_PATH = (
    r"""[A-Za-z]:\\(?:[^\x00-\x1f<>:"/\\|?*]++\\)++[^\x00-\x1f<>:"/\\|?*]*"""
)
USER_IN_PATH = r"(?i)\\Users\\([^\\]+)\\"
USER_IN_PROFILE_PATH = r"(?i)\\(?:Users|Documents and Settings)\\([^\\]+)\\"
XMP_STRING = r"(?i)<(?:dc|xmp|pdf|photoshop):([A-Za-z][A-Za-z0-9_-]*)[^>]*>([^<]+)<"
INDICATOR_URL = r"""(?i)(?:https?|ftp|ldap)://[^\x00-\x20<>"']{3,}"""
INDICATOR_PATH = r"""(?:[A-Za-z]:\\|\\\\)[^\x00-\x1f<>:"|?*]{2,}"""
INDICATOR_PRINTER = r"(?i)(?:winspool|printer|printto)[\x00:= ]{0,4}[^\x00\r\n]{3,}"
INDICATOR_APPLICATION = (
    r"(?i)(?:Adobe|Acrobat|InDesign|LibreOffice|OpenOffice|Microsoft (?:Word|Excel|PowerPoint)"
    r"|Corel WordPerfect)[^\x00\r\n]*"
)
LOOSE_XMP_ELEMENT = r"(?i)<(?:dc|xmp|xap|pdf|photoshop):([A-Za-z][A-Za-z0-9_-]*)[^>]*>([^<]+)<"
LOOSE_XMP_ATTRIBUTE = (
    r"""(?i)(?:dc|xmp|xap|pdf|photoshop):([A-Za-z][A-Za-z0-9_-]*)\s*=\s*["']([^"']+)["']"""
)
DIAGNOSTIC_URL = r"""(?i)https?://[^\s<>"']+"""

# Accepted date spellings (read as UTC when no offset is given).
DATE_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?\s?(?:Z|[+-]\d{2}:\d{2})?$"
DATE_PDF = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:Z.*|([+-]\d{2})'(\d{2})'?)?$"
DATE_EXIF = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$"
DATE_RFC1123 = r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$"
DATE_SLASHED = r"^\d{2}/\d{2}/\d{4}( \d{2}:\d{2}:\d{2})?$"

# Column order of the CSV exports, and the columns that redaction hides.
CSV_COLUMNS = {
    "entities": ["id", "type", "value", "normalized_value", "confidence"],
    "observations": ["id", "artifact_id", "category", "original_value", "normalized_value", "extractor", "location",
                     "confidence"],
    "relations": ["id", "from_entity_id", "to_entity_id", "type", "evidence_id", "confidence"],
}
CSV_HIDDEN = {
    "entities": ["value", "normalized_value"], "observations": ["original_value", "normalized_value", "location"],
    "relations": [],
}

# Texts that stand in results (not only in diagnostics).
MIME_MISMATCH = ("Extension suggests ", ", magic bytes identify ")
CONTAINER_ERROR = "Invalid ZIP container"
BACKUP_TITLE = "Potential backup file exposed"
UNKNOWN_PROVIDER = "Provider is not registered."
