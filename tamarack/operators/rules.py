"""Primitive detectors over text parts, the rules that scope them to parts, and rule ids of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import fixed

#: What each primitive detector looks for; plain regular expressions that any engine reads alike.
PRIMITIVES = {
    "uncCoercion": r"\\\\[^\\\s\"<>]+\\",
    "dangerousProtocol": r"(?i)(ms-msdt|search-ms|ms-appinstaller|mhtml|javascript|vbscript):",
    "stagedCommand": r"(?i)(powershell|cmd\.exe|mshta|wscript|cscript|rundll32|regsvr32|certutil|bitsadmin)",
    "executableTarget": r"(?i)\.(exe|dll|scr|bat|ps1|hta|vbs|jse?|wsf|lnk)([?#\"'\s<]|$)",
    "peBinary": r"TV[qpro]Q[A-Za-z0-9+/]|^MZ",
    "cloakedDde": r"(?i)[=+@＝-]\s*(\"?[a-z0-9_.]+\"?)\|'[^']*'!",
    "xlmCall": r"(?i)(EXEC|CALL|REGISTER)\s*\(",
    "databaseCommand": r"(?i)(xp_cmdshell|sp_OACreate|OPENROWSET)",
    "xxeDtdDeclaration": r"<!(DOCTYPE|ENTITY)",
    "macroHook": r"(?i)(auto_?open|auto_?exec|workbook_open|document_open)",
    "clsid": r"(?i)72c24dd5-d70a-438b-8a42-98424b88afb8|0002ce02-0000-0000-c000-000000000046",
    "remoteTemplateInjection": r"(?i)attachedTemplate[^>]*https?://",
    "relationshipCloak": r"%00|‮|(?i:%6a%61%76%61|\\\\\.\\pipe|127\.0\.0\.1@)",
    "veryHidden": r"(?i)state=\"veryHidden\"",
    "remoteWorkbook": r"(?i)(\\\\[^\\\s\"<>]+\\|https?://)[^\"<>\[\]]*\[[^\]\"<>]+\]",
    "webService": r"(?i)(WEBSERVICE|FILTERXML)\s*\(",
    "hyperlinkPayload": r"(?i)HYPERLINK\s*\([^)]*(\.(exe|scr|bat|cmd|ps1|hta|vbs|jse?|lnk|zip|iso)|search-ms:|ms-msdt:)",
    "rtdCall": r"(?i)RTD\s*\(",
    "autoName": r"(?i)definedName[^>]*name=\"(_xlnm\.)?auto_?(open|close|activate|deactivate)",
    "externalOle": r"(?i)<Relationship\s[^>]*(oleObject[^>]*TargetMode=\"External\"|TargetMode=\"External\"[^>]*oleObject)",
    "externalSubdocument": r"(?i)<Relationship\s[^>]*((subDocument|frame)\"[^>]*TargetMode=\"External\"|TargetMode=\"External\"[^>]*(subDocument|frame)\")",
    "truncatedSignature": r"(?s)\A.{0,7}\z",
    "fieldCode": r"(?i)instrText[^>]*>[^<]*(DDEAUTO|DDE|INCLUDETEXT|LINK)\s",
    "altChunkPayload": r"(?i)(<script|\{\\rtf|aFChunk\"[^>]*TargetMode=\"External\")",
    "dialogMacro": r"(?i)FmlaMacro",
    "contentType": r"(?i)(PartName=\"[^\"]*/\.\./|application/(x-msdownload|hta)|PartName=\"[^\"]*\.(png|jpe?g|gif)\"[^>]*vbaProject)",
    "lockStructure": r"(?i)lockStructure=\"(1|true)\"",
    "viewEvasion": r"(?i)(<(col|row)\s[^>]*(hidden=\"(1|true)\"|\s(width|ht)=\"0\")|topLeftCell=\"[A-Z]{3}[0-9]+\"|showGridLines=\"0\"[^>]*showRowColHeaders=\"0\")",
    "moniker": r"(?i)((moniker|script|composite|file):|UpdateMode=\"Always\"|auto(Update|Activate)=\"(1|true)\")",
    "namespaceCloak": r"(?i)(xmlns(:[a-z0-9]+)?|schemaLocation)=\"[^\"]*\\\\[^\"]+",
    "bindingXPath": r"(?i)(xpath|prefixMappings)=\"[^\"]*(\\\\|https?://|document\()",
}

#: Parts that a rule looks at (a pattern on the path) and the primitives that count there.
SCOPES = (
    (1, r"^xl/worksheets/", ("cloakedDde",)),
    (2, r"^xl/worksheets/", ("xlmCall",)),
    (7, r"^xl/workbook\.xml$", ("veryHidden",)),
    (10, r"^word/settings\.xml$", ("remoteTemplateInjection",)),
    (15, r"printerSettings", ("uncCoercion",)),
    (16, r"customXml/item", ("peBinary", "xxeDtdDeclaration")),
    (17, r"\.(xml|rels)$", ("dangerousProtocol",)),
    (18, r"/drawings/", ("macroHook", "executableTarget")),
    (19, r"^xl/connections\.xml$", ("uncCoercion", "stagedCommand")),
    (21, r"\.svg$", ("dangerousProtocol", "stagedCommand")),
    (24, r"^ppt/slides/", ("stagedCommand", "executableTarget")),
    (26, r"customUI", ("macroHook", "stagedCommand")),
    (29, r"externalLinks/", ("uncCoercion", "executableTarget")),
    (30, r"webSettings", ("dangerousProtocol", "uncCoercion")),
    (34, r"activeX", ("clsid",)),
    (35, r"^word/glossary/document", ("cloakedDde", "uncCoercion")),
    (37, r"/ink/", ("uncCoercion", "dangerousProtocol")),
    (38, r"^docProps/", ("uncCoercion", "stagedCommand", "peBinary")),
    (39, r"webextensions/|taskpanes", ("uncCoercion", "dangerousProtocol")),
    (40, r"pivotCache/", ("databaseCommand", "uncCoercion")),
    (42, r"\.xslt?$", ("dangerousProtocol", "stagedCommand")),
    (43, r"\.rels$", ("relationshipCloak",)),
    (44, r"/diagrams/", ("uncCoercion", "stagedCommand")),
    (46, r"queryTables/", ("uncCoercion", "stagedCommand")),
    (47, r"customXml/.*mashup|^xl/queries", ("stagedCommand", "uncCoercion")),
    (50, r"slicer|timeline", ("stagedCommand", "uncCoercion", "databaseCommand")),
    (51, r"bibliography|citation", ("uncCoercion", "stagedCommand")),
    (53, r"xmlMaps", ("uncCoercion", "xxeDtdDeclaration")),
    (54, r"comments", ("uncCoercion", "dangerousProtocol", "stagedCommand")),
    (55, r"/theme/", ("uncCoercion", "dangerousProtocol", "stagedCommand")),
    (56, r"customXml/itemProps", ("uncCoercion", "dangerousProtocol", "stagedCommand")),
    (57, r"vbaData|vbaProject.*rels", ("uncCoercion", "stagedCommand")),
    (59, r"^word/(settings|footnotes|endnotes)", ("stagedCommand", "uncCoercion")),
    (60, r"^ppt/(tags|slideMasters)", ("stagedCommand", "uncCoercion")),
    (63, r"^word/(header|footer)", ("uncCoercion", "executableTarget")),
    (64, r"^xl/(model|calcChain)", ("uncCoercion", "databaseCommand")),
    (66, r"embeddings/", ("peBinary",)),
    (67, r"externalLinks/", ("relationshipCloak",)),
    (68, r"activeX.*\.bin$", ("peBinary", "stagedCommand")),
    (69, r"^_xmlsignatures/", ("uncCoercion", "dangerousProtocol")),
    (70, r"ctrlProps/", ("cloakedDde", "macroHook", "stagedCommand")),
    (71, r"^ppt/media/", ("peBinary", "stagedCommand")),
    (74, r"^ppt/presProps", ("uncCoercion", "stagedCommand")),
    (75, r"threadedComments/|persons/", ("uncCoercion", "dangerousProtocol")),
    (76, r"themeOverride", ("uncCoercion", "stagedCommand")),
    (78, r"^word/customizations", ("macroHook", "stagedCommand")),
    (82, r"customProperty|customData", ("uncCoercion", "peBinary")),
    (85, r"queryTables/", ("databaseCommand",)),
    (89, r"^ppt/slide(Master|Layout)s/", ("uncCoercion", "stagedCommand")),
    (90, r"^word/_rels/settings|^word/settings", ("uncCoercion",)),
    (92, r"^ppt/(viewProps|tableStyles)", ("uncCoercion", "stagedCommand", "dangerousProtocol")),
    (93, r"^word/numbering", ("uncCoercion", "stagedCommand", "dangerousProtocol")),
    (94, r"^xl/(metadata|richData)", ("uncCoercion", "stagedCommand", "dangerousProtocol")),
    (3, r"^xl/worksheets/", ("remoteWorkbook",)),
    (4, r"^xl/worksheets/", ("webService",)),
    (5, r"^xl/worksheets/", ("hyperlinkPayload",)),
    (6, r"^xl/workbook\.xml$", ("autoName",)),
    (12, r"\.rels$", ("externalOle",)),
    (14, r"\.rels$", ("externalSubdocument",)),
    (20, r"^xl/(worksheets/|workbook\.xml$)", ("rtdCall",)),
    (22, r"vbaProjectSignature.*\.bin$", ("truncatedSignature",)),
    (23, r"^word/(document|header|footer)", ("fieldCode", "uncCoercion")),
    (25, r"(?i)afchunk|^word/_rels/document", ("altChunkPayload", "peBinary")),
    (27, r"^xl/dialogsheets/", ("dialogMacro",)),
    (28, r"^\[Content_Types\]\.xml$", ("contentType",)),
    (31, r"^xl/workbook\.xml$", ("lockStructure",)),
    (32, r"\.(xml|rels|png|jpe?g|gif)$", ("peBinary",)),
    (33, r"^xl/worksheets/", ("viewEvasion",)),
    (36, r"/fonts/|\.(odttf|ttf|woff2?)$", ("peBinary", "stagedCommand")),
    (41, r"\.(wmf|emf)$", ("peBinary", "stagedCommand")),
    (45, r"^word/(_rels/)?settings", ("databaseCommand", "uncCoercion", "executableTarget")),
    (48, r"/(embeddings|drawings|slides)/", ("moniker",)),
    (49, r"\.(xml|rels)$", ("namespaceCloak", "xxeDtdDeclaration")),
    (52, r"^word/document", ("bindingXPath",)),
    (58, r"^word/glossary/", ("remoteTemplateInjection", "uncCoercion", "dangerousProtocol", "peBinary")),
    (61, r"^xl/worksheets/|scenario|consolidat", ("cloakedDde", "xlmCall", "stagedCommand", "uncCoercion")),
    (62, r"^ppt/slides/", ("stagedCommand", "uncCoercion", "dangerousProtocol", "peBinary")),
    (65, r"pivotCache/", ("uncCoercion", "databaseCommand", "dangerousProtocol", "cloakedDde", "peBinary")),
    (72, r"^xl/(tables|slicers|timelines)/", ("uncCoercion", "cloakedDde", "databaseCommand", "peBinary")),
    (73, r"^word/settings|recipientData", ("uncCoercion", "dangerousProtocol", "databaseCommand")),
    (77, r"^ppt/(commentAuthors|syncInfo|slideSync)", ("uncCoercion", "cloakedDde", "dangerousProtocol", "stagedCommand")),
    (79, r"^xl/(webPublish|worksheets/)", ("uncCoercion", "dangerousProtocol", "stagedCommand")),
    (80, r"^ppt/(handout|notes)Masters/", ("uncCoercion", "cloakedDde", "dangerousProtocol", "stagedCommand")),
    (81, r"^word/glossary/(settings|webSettings|fontTable)", ("uncCoercion", "macroHook", "dangerousProtocol", "executableTarget")),
    (83, r"^word/(subDocument|masterDocument)", ("uncCoercion", "dangerousProtocol", "stagedCommand", "peBinary")),
    (84, r"^ppt/(fontTable|fonts/)", ("uncCoercion", "dangerousProtocol", "stagedCommand", "peBinary")),
    (86, r"^ppt/(viewProps|slideGuides/|guides/)", ("uncCoercion", "dangerousProtocol", "stagedCommand", "peBinary")),
    (87, r"^word/(mailMergeFilter|recipientData)", ("uncCoercion", "dangerousProtocol", "databaseCommand", "stagedCommand")),
    (88, r"^xl/(dataServices|externalDataFeeds|dataFeeds)/|connections/dataService", ("uncCoercion", "dangerousProtocol", "databaseCommand", "cloakedDde")),
    (91, r"^xl/(dataBindings|bindings)/|connections/binding", ("uncCoercion", "dangerousProtocol", "databaseCommand", "cloakedDde", "stagedCommand")),
)

#: Parts whose mere presence is a finding.
PRESENT = (
    (8, r"^xl/macrosheets/"),
    (11, r"/embeddings/.*\.bin$"),
    (13, r"(?i)/activex/.*\.bin$"),
    (32, r"(?i)\.(exe|dll|sys|scr|bat|cmd|ps1|vbs|hta|lnk|iso)$"),
)


def detect(parts: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, detector) of the primitives that fire on each row's content, in one pass over it."""
    hits = F.filter(F.array(*[F.when(F.col(content).rlike(p), F.lit(n)) for n, p in PRIMITIVES.items()]), lambda x: x.isNotNull())
    return parts.select(*key, F.explode(hits).alias("detector"))


def scan_parts(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, rule_id, kind, detector) of parts (part, content): detectors that fire within a rule's scope.

    A part whose presence is a finding has the detector "present". Null contents have no other.
    """
    spark = parts.sparkSession
    scopes = spark.createDataFrame([(n, p, d) for n, p, ds in SCOPES for d in ds], "rule_no int, path string, detector string")
    hits = detect(parts, [*dict.fromkeys([*key, "part"])], "content")
    # The scopes are a fixed table of a few hundred rows at most.
    j = hits.join(F.broadcast(scopes), "detector").where(F.expr("rlike(part, path)")).select(*key, "rule_no", "detector")
    there = F.filter(F.array(*[F.when(F.col("part").rlike(p), F.lit(n)) for n, p in PRESENT]), lambda x: x.isNotNull())
    j = j.unionByName(parts.select(*key, F.explode(there).alias("rule_no"), F.lit("present").alias("detector")))
    kinds = F.array(*[F.lit(k) for k in fixed.CELL_KINDS])
    return j.select(*key, F.concat(F.lit("VBA-CELL-"), F.lpad(F.col("rule_no").cast("string"), 3, "0")).alias("rule_id"), F.element_at(kinds, F.col("rule_no")).alias("kind"), "detector").distinct()


def _level(severity, default):
    out = default
    for s, lv in fixed.SEVERITY_LEVELS.items():
        out = F.when(severity == s, lv).otherwise(out)
    return out


def with_rules(findings: DataFrame) -> DataFrame:
    """findings (kind, severity, ...) with rule_id and level; an unknown kind is the first rule at warning."""
    rows = [(k, n) for n, c in enumerate(fixed.CELL_KINDS, 1) for k in (c, *fixed.CELL_ALIASES.get(n, ()))]
    table = findings.sparkSession.createDataFrame([(k, f"VBA-CELL-{n:03d}", fixed.CELL_LEVELS.get(n, "error")) for k, n in rows], "kind string, rule_id string, default_level string")
    j = findings.join(F.broadcast(table), "kind", "left")
    return j.withColumn("rule_id", F.coalesce("rule_id", F.lit("VBA-CELL-001"))).withColumn("level", _level(F.col("severity"), F.coalesce("default_level", F.lit("warning")))).drop("default_level")


def with_stomp_rules(findings: DataFrame) -> DataFrame:
    """The same for findings of source against compiled code."""
    table = findings.sparkSession.createDataFrame([(k, f"VBA-STOMP-{n:03d}", lv) for n, (k, lv) in enumerate(fixed.STOMP_KINDS, 1)], "kind string, rule_id string, default_level string")
    return findings.join(F.broadcast(table), "kind", "left").withColumn("level", _level(F.col("severity"), F.col("default_level"))).drop("default_level")
