"""Message catalogue of the restart log analysis.

FIXED VALUES — these must equal the source application's catalogue for the
results to agree.  They are stated as plain text, in their natural order.
"""

# FIXED VALUES: the 36 message patterns a log line must match to be parsed
# (extended regular expressions, matched anywhere in the line, in file order).
MESSAGE_PATTERNS = [
    "AOF302I", "AAT103I", "DSI039I", "Z*EOD", "TN3270", "IEA371I", "IEE341I",
    "AOF570I", "IEE345I", "AOF571I", "IEE838I", "IEE342I", "IEE301I",
    "IEF122I", "IEE252I", "IKT010D", "IEE122I", "IEE707I", "IEAVN701",
    "IEAVC701", "SHUTDOWN", "HZS0115I", "HZS0103I", "AOF749I", "IPLTRK",
    "IXC101I", "IXC371D", "HASP", "IAT4", "P*JES", "JES2", "JES3", "IEF404I",
    "TSO", "IPLINFO", "IPLED",
]

# FIXED VALUES: event classes and the literal tokens that select them, in
# precedence order (first matching class wins).
SHUTDOWN_BEGIN = "SHUTDOWN BEGIN"
END_OF_SHUTDOWN = "END OF SHUTDOWN"
IPL_BEGIN = "IPL BEGIN"
IPL_END = "IPL END"
PRE_IPL = "PRE IPL"
POST_IPL = "POST IPL"
SYSTEM_IPLED = "SYSTEM IPLED"

SHUTDOWN_BEGIN_TOKENS = ["TSO IS SHUTTING DOWN", "DSI039I"]
END_OF_SHUTDOWN_TOKENS = ["Z EOD", "IXC371D", "JES2 TERMINATION COMPLETE",
                          "PJES2", "P JES2", "JES3 IS AUTODOWN"]
# END OF SHUTDOWN also when the line holds JES3 and the 8th word holds IEF404I
END_OF_SHUTDOWN_JES3 = "JES3"
END_OF_SHUTDOWN_JES3_WORD8 = "IEF404I"
IPL_BEGIN_TOKENS = ["IEA371I"]
IPL_END_TOKENS = ["HZS0103I", "S TN3270", "S SSHD"]
PRE_IPL_TOKENS = ["IPLTRK01I"]
POST_IPL_TOKENS = ["IPLTRK02I"]
SYSTEM_IPLED_TOKEN = "SYSTEM IPLED"

# FIXED VALUES: error words; a line with no class but one of these is flagged 'y'
ERROR_TOKENS = ["ERROR", "UNAUTHORIZED", "ABEND", "NOT FOUND", "NOT DEFINED",
                "PROBLEM", "INSUFFICIENT"]

# FIXED VALUES: a dataset is kept only if its type column matches this
# (the starred forms do not match blank-separated labels, so in effect only
# types containing IPL count).
DATASET_KEEP_TYPE_PATTERN = "SHUTDOWN*BEGIN|END*OF*SHUTDOWN|IPL|IPLED"

# FIXED VALUES: catalogue listing filter and the number of newest datasets kept
DATASET_NAME_MUST_CONTAIN = "LOG"
DATASET_LISTING_SKIP = "IN-CAT"
DATASETS_KEPT_PER_QUALIFIER = 90

# FIXED VALUES: names of resume files (any case)
RESUME_FILE_PATTERN = "(?i)resume.*[.]csv$"
RESUME_FILE_GLOB = "*[rR][eE][sS][uU][mM][eE]*.[cC][sS][vV]"

# FIXED VALUES: pseudo-epoch weights (seconds per year / month / day)
SECONDS_PER_YEAR_APPROX = 31557600
SECONDS_PER_MONTH_APPROX = 2629800


def prefilter_regex() -> str:
    """All message patterns OR-ed into one regular expression."""
    return "|".join(MESSAGE_PATTERNS)
