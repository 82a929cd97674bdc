"""Word lists, maps and sizes that results depend on."""

from __future__ import annotations

# The 26 words that lex as keywords.
KEYWORDS = (
    "ACCEPT ADD CALL COMPUTE DATA DISPLAY DIVIDE DIVISION ELSE END-IF ENVIRONMENT IDENTIFICATION IF MOVE MULTIPLY PERFORM PIC "
    "PROCEDURE PROGRAM-ID RUN STOP SUBTRACT VALUE WORKING-STORAGE ZEROS SPACES"
).split()

# The 50 words that no data item may be named.
RESERVED = (
    "ACCEPT ADD ALPHABETIC ALPHANUMERIC ALTER AND CALL CANCEL CLOSE COMPUTE CONTINUE DATA DELETE DISPLAY DIVIDE ELSE END EVALUATE "
    "EXIT FILE GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY NEXT NOT OPEN OR PERFORM PROCEDURE READ RELEASE RETURN REWRITE "
    "SEARCH SECTION SET SORT START STOP STRING SUBTRACT THEN UNSTRING WHEN WRITE"
).split()

# Figurative constants.
FIGURATIVE = "SPACES SPACE ZEROS ZERO ZEROES HIGH-VALUES HIGH-VALUE LOW-VALUES LOW-VALUE QUOTES QUOTE ALL NULL NULLS".split()

# Statement verbs, and the word that splits the operands of some.
VERBS = "DISPLAY MOVE STOP GOBACK ACCEPT ADD SUBTRACT MULTIPLY DIVIDE CALL".split()
SPLIT = {"MOVE": "TO", "ADD": "TO", "SUBTRACT": "FROM", "MULTIPLY": "BY", "DIVIDE": "INTO"}
#: Verbs that extended mode adds.
EXTENDED_VERBS = ["PERFORM", "GO"]

# Words that end the identification division, the data division and a procedure division's loops.
DIVISIONS = ["IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE"]
AFTER_IDENTIFICATION = ["ENVIRONMENT", "DATA", "PROCEDURE"]
AFTER_DATA = ["ENVIRONMENT", "PROCEDURE", "IDENTIFICATION"]
AFTER_PROCEDURE = ["IDENTIFICATION", "ENVIRONMENT", "DATA"]
SECTIONS = ["WORKING-STORAGE"]  # of the section words, the only one that lexes as a keyword
CLAUSES = ["AUTHOR", "INSTALLATION", "DATE-WRITTEN", "DATE-COMPILED", "SECURITY"]

# Levels of data items.
LEVELS = [*range(1, 50), 66, 77, 78, 88]

# USAGE words.
USAGE = {
    "DISPLAY": "DISPLAY", "COMP": "COMP", "COMP-4": "COMP", "BINARY": "COMP", "COMP-1": "COMP-1", "COMP-2": "COMP-2", "COMP-3": "COMP-3",
    "PACKED-DECIMAL": "COMP-3", "COMP-5": "COMP-5", "INDEX": "INDEX", "POINTER": "POINTER",
}

# File types by extension, in the order in which a summary lists ties.
FILE_TYPES = ["COBOL", "Copybook", "JCL", "PROC", "BMS", "XML", "JSON", "Text", "Unknown"]
TYPE_OF = {".cbl": "COBOL", ".cob": "COBOL", ".cpy": "Copybook", ".jcl": "JCL", ".proc": "PROC", ".prc": "PROC", ".bms": "BMS", ".xml": "XML", ".json": "JSON", ".txt": "Text"}

# What an upload may hold, and its largest size in MB.
UPLOADS = [".cbl", ".cob", ".cpy", ".jcl", ".txt", ".zip"]
MAX_MB = 20

# Bytes looked at to tell a file's type and encoding, and thresholds of the EBCDIC test.
SAMPLE = 4096
EBCDIC_LEAST, EBCDIC_PRINTABLE, EBCDIC_ODD = 8, 0.50, 0.10

# Thresholds of the fixed-format test, and the columns of fixed-format code (0-based, end exclusive).
FIXED_LINES, FIXED_SHARE = 5, 0.6
CODE_COLUMNS = (6, 72)
