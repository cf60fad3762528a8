"""Fixed values.

Every word list, lookup table, pattern and constant whose exact value decides the result is kept
here as plain text, in its natural order.  Nothing in this module computes anything.
"""

# ---------------------------------------------------------------------------------------------
# fixed values: generic header dictionary (logical column -> header words, first match wins)
# ---------------------------------------------------------------------------------------------
HEADER_WORDS = {
    "datetime": ["datetime", "วันที่เวลา", "date_time", "timestamp"],
    "date": ["วันที่", "date", "วันที่ทำรายการ", "transaction date"],
    "time": ["เวลา", "time"],
    "desc": ["รายการ", "รายละเอียด", "description", "detail", "narrative", "merchant"],
    "debit": ["ถอน", "ถอนเงิน", "โอนออก", "debit", "withdraw"],
    "credit": ["ฝาก", "ฝากเงิน", "รับเข้า", "credit", "deposit"],
    "balance": ["คงเหลือ", "ยอดคงเหลือ", "balance"],
    "channel": ["ช่องทาง", "channel"],
    "account": ["เลขที่บัญชี", "บัญชี", "account", "account_no"],
    "amount": ["จำนวนเงิน", "ยอดเงิน", "amount", "ยอด"],
    "username": ["username", "ผู้ใช้", "user", "employee"],
    "company": ["company", "บริษัท", "merchant"],
    "status": ["status", "สถานะ"],
    "bank": ["bank", "ธนาคาร"],
    "txid": ["transaction_id", "txid", "ref", "เลขที่รายการ", "reference"],
    "direction": ["direction", "ประเภทรายการ", "type"],
}

# fixed values: bank hints in a generic file (last matching entry wins)
BANK_HINTS = [
    ("SCB", ["scb", "ไทยพาณิชย์"]),
    ("KBANK", ["kbank", "kasikorn", "กสิกร"]),
    ("GSB", ["gsb", "ออมสิน", "mymo"]),
    ("BBL", ["bbl", "bangkok bank", "กรุงเทพ"]),
    ("KTB", ["ktb", "krungthai", "กรุงไทย"]),
]
# fixed values: words that mark a gateway file, and company hints (last matching entry wins)
GATEWAY_BLOB_WORDS = ["autopeer", "azpay", "cyberplus", "12pay", "mypay", " atp "]
COMPANY_HINTS = ["AUTOPEER", "AZPAY", "CYBERPLUS", "12PAY", "MYPAY", "SYS123"]

# fixed values: lines that carry no transaction
CARRY_FORWARD = ["ยอดยกมา", "ยอดยกไป", "balance b/f", "brought forward"]
CYCLE_LINE = ["รอบวันที่", "statement period", "รอบบัญชี"]

# ---------------------------------------------------------------------------------------------
# fixed values: report formats (code, side, headers that must all be present), tried in order
# ---------------------------------------------------------------------------------------------
REPORT_SPECS = [
    ("bo_main", "bo", ["วันที่ทำรายการ", "วันที่ธนาคาร", "จำนวนเงินฝากจริง", "จำนวนเงินถอนจริง", "ชื่อธนาคาร"]),
    ("manual_credit", "bo", ["เวลาทำรายการ", "เวลาธนาคาร", "เลขบัญชีธนาคารสมาชิก", "เลขบัญชีธนาคารบริษัท", "จำนวน"]),
    ("manual_payment", "bo", ["เวลาทำรายการ", "เลขคำสั่งชำระ", "ช่องทาง", "บัญชีบริษัท", "จำนวน"]),
    ("manual_bonus", "aux", ["เวลาทำรายการ", "โปรโมชั่น", "ยอดก่อนเติม", "โบนัส"]),
    ("comm_req", "aux", ["วัน/เวลา", "รหัสสมาชิก", "จำนวนเงิน", "สถานะ", "ดำเนินการโดย"]),
    ("credit_out", "aux", ["เวลาทำรายการ", "รหัสสมาชิก", "เครดิตก่อน", "จำนวน", "เครดิตหลัง"]),
]
REPORT_HEADER_ROWS = 10
GATEWAY_HEADER_ROWS = 12

# fixed values: gateway report header words
PM_DATE = ["paymenttime", "วันเวลาอัพเดต", "วันที่ทำรายการ", "วันที่", "requesttime"]
PM_STATUS = ["status", "สถานะ"]
PM_AMOUNT_DEPOSIT = ["โอนจริง", "จำนวนเงิน", "amount", "สร้างฝาก", "realamount"]
PM_AMOUNT_WITHDRAW = ["p2pจ่าย", "p2p จ่าย", "โอนจริง", "รวมหักเงิน", "จำนวนเงิน", "amount"]

# fixed values: gateway report columns read for a row, first non-blank wins
PM_ROW_STATUS = ["status", "สถานะ"]
PM_ROW_TIME = ["paymentTime", "วันเวลาอัพเดต", "วันที่ทำรายการ", "วันที่", "requestTime"]
PM_ROW_ID = ["id", "Ref Id", "Ref", "reference"]
PM_ROW_PAID = ["P2P จ่าย", "p2pจ่าย", "โอนจริง", "จำนวนเงิน", "รวมหักเงิน", "amount"]
PM_ROW_RECEIVED = ["โอนจริง", "จำนวนเงิน", "amount", "สร้างฝาก", "realAmount"]
PM_ROW_REQUESTED = ["แจ้งถอน", "สร้างฝาก"]
PM_ROW_FEE = ["ค่าธรรมเนียม", "fee"]
PM_ROW_MEMBER = ["Username", "user ที่ฝาก", "ยูสเซอร์", "customerId"]
PM_ROW_CUST_NAME = ["ชื่อ - นามสกุล ผู้รับ", "payee"]
PM_ROW_CUST_BANK = ["ธนาคาร", "ธนาคารต้นทาง"]
PM_ROW_REF = ["Ref", "Ref Id", "reference", "id"]
PM_SUCCESS = "success|สำเร็จ"
PM_WITHDRAW_ID = "(?i)^(wd|wit|wtd)"

# fixed values: status words that pass (a blank status also passes)
OK_STATUS = ["สำเร็จ", "ถอนสำเร็จ", "success", "อนุมัติ"]

# fixed values: provider by substring of a file name, in order
PM_PROVIDERS = [
    ("mypay", "MYPAY"), ("autopeer", "AUTOPEER"), ("atp", "AUTOPEER"), ("azpay", "AZPAY"),
    ("cyberplus", "CYBERPLUS"), ("cby", "CYBERPLUS"), ("12pay", "12PAY"),
]
# fixed values: channel text (letters and digits only) -> canonical gateway, in order
CANONICAL_PM = [
    ("CYBER|CYNER|CBY", "CYBERPLUS"), ("AUTOPEER|ATP", "AUTOPEER"), ("AZPAY|^AZ$", "AZPAY"),
    ("MYPAY", "MYPAY"), ("12PAY", "12PAY"),
]
SUBCO_BRAND_PREFIX = "(?i)^ufabet"

# fixed values: free-text hints in a note
NOTE_ENTITLED = r"ได้รับ(?:ยอด)?(?:จริง|ภายในเดือน)\s*([\d,]+(?:\.\d+)?)"
NOTE_EXCESS = r"สะสมเกิน(?:เดือน)?\s*([\d,]+(?:\.\d+)?)\s*บาท"

# fixed values: precedence when the same reference appears in several reports
MERGE_RANK = {"bo_main": 3, "manual_credit": 2, "manual_payment": 1}
MERGE_FILL = ["cust_account", "cust_name", "bank", "credit_before", "credit_after", "member_code",
              "member_nick", "note", "pay_order"]

# ---------------------------------------------------------------------------------------------
# fixed values: bank statements
# ---------------------------------------------------------------------------------------------
STATEMENT_AMOUNT = r"^-?[\d,]+\.\d{2}$"
# bank by page text, tried in order; LBK looks at every page, the others at the first page
STATEMENT_BANKS = [
    ("SCB", "first", "(?i)ไทยพาณิชย์|SIAM COMMERCIAL"),
    ("LBK", "all", r"(?i)LINE\s*BK|ไลน์\s*บีเค"),
    ("KBANK", "first", "(?i)กสิกร|KASIKORN|K PLUS|เลขที่บัญชีเงินฝาก"),
    ("GSB", "first", "(?i)ออมสิน|MyMo|GSB"),
    ("BBL", "first", "(?i)ธนาคารกรุงเทพ|BANGKOK BANK"),
    ("KTB", "first", "(?i)กรุงไทย|KRUNGTHAI"),
    ("BAY", "first", "(?i)กรุงศรี|อยุธยา|KRUNGSRI|AYUDHYA"),
]
TMN_WORDS = ["เงินเข้า", "เงินออก", "ยอดคงเหลือ"]
ACCOUNT_LABEL = r"(?i)(?:เลข(?:ที่)?บัญชี(?:เงินฝาก)?|Account No\.?)\s*[:\s]*([\d-]{9,20})"
ACCOUNT_SHAPE = r"(?:^|[^A-Za-z0-9_])(\d{3}-\d{1,6}-\d{1,2})(?![A-Za-z0-9_])"
HOLDER_PATTERNS = [r"ชื่อ\s*-?\s*สกุล\s*([^\n]{3,60})", r"ชื่อบัญชี\s*([^\n]{2,40}?)\s*เลขที่บัญชี",
                   r"ชื่อบัญชี\s*([^\n]{3,60})"]
PERIOD_PATTERN = r"(\d{1,2}/\d{1,2}/\d{2,4})\s*-\s*(\d{1,2}/\d{1,2}/\d{2,4})"
SCB_LINE = (r"^(\d{1,2}/\d{1,2}/\d{2,4})\s+(\d{1,2}:\d{2})\s+(X[0-9B]|[A-Z]{1,3})\s+([A-Z/]+)\s+"
            r"([\d,]+\.\d{2})\s+([\d,]+\.\d{2})")
KBANK_KINDS = "(รับโอนเงิน|โอนเงิน|ฝากเงิน|ถอนเงิน|หักบัญชี|ดอกเบี้ย|ค่าธรรมเนียม)"
KBANK_SKIP = "ยอดยกมา|ยอดยกไป"
TMN_LINE = (r"^(\d{2}/\d{2}/\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(เงินเข้า|เงินออก)\s+(-?[\d,]+\.\d{2})\s+(.+?)\s+"
            r"([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s*$")
TMN_FEE = r"(?i)^(fee_|.*_fee$|promptpay_.*_fundout$|.*_fundout$)"
BAY_LINE = (r"^(\d{2}/\d{2}/\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(.+)\s+([\d,]+(?:\.\d{2})?)\s+([\d,]+(?:\.\d{2})?)\s+"
            r"([A-Za-zก-๙/]+)\s*(.*)$")
BAY_SKIP = "ยอดยกมา|ยอดยกไป|ยอดคงเหลือ"
BAY_DESTINATION = "^บัญชีปลายทาง"
KTB_KINDS = "(เงินโอนเข้า|โอนเงินออก|รับโอนเงิน|โอนเงิน|ฝากเงิน|ถอนเงิน|หักบัญชี|ดอกเบี้ย|ค่าธรรมเนียม)"
SCB_CODES = [("X1", "deposit"), ("X2", "withdraw"), ("XB", "adjustment")]
DEPOSIT_WORDS = "(?i)รับโอน|ฝากเงิน|เงินเข้า|TRF FR|deposit"
WITHDRAW_WORDS = "(?i)โอนเงิน|โอนไป|ถอน|เงินออก|หักบัญชี|ค่าธรรมเนียม|TRF TO|withdraw"

# fixed values: drop reasons
DROP_CARRY = "กรองบรรทัดยอดยกมา"
DROP_CYCLE = "กรองบรรทัดรอบวันที่"
DROP_NO_TIME = "ไม่มีเวลาที่อ่านได้"
DROP_WRONG_DATE = "วันที่ไม่ตรงกับวันที่ตรวจ"
DROP_NO_AMOUNT = "ไม่มียอดเงิน"
DROP_ZERO = "ยอดเงินเป็นศูนย์"
DROP_ADJUSTMENT = "รายการปรับปรุงยอด (XB) แยกออกจากการจับคู่"
DROP_PM_STATUS = "รายการไม่สำเร็จ (PM)"
DROP_STATUS = "รายการไม่สำเร็จ"
DROP_UNREADABLE = "อ่านเวลาหรือยอดไม่ได้"
DROP_FEE = "ค่าธรรมเนียม/โยกเงินออกธนาคาร TrueMoney (ไม่ใช่รายการลูกค้า)"

# fixed values: warnings
WARN_NO_ROWS = "อ่านไฟล์ได้แต่ไม่พบรายการที่ใช้จับคู่ได้ — ตรวจหัวคอลัมน์อีกครั้ง"
WARN_UNKNOWN_SOURCE = "ระบุไม่ได้ว่าเป็น STM, BO หรือ PM — ระบบจะถือว่าเป็น STM"
WARN_REPORT_EMPTY = "อ่านหัวคอลัมน์ได้แต่ไม่มีบรรทัดข้อมูลที่ใช้ได้"
WARN_NO_BANK = "ระบุธนาคารจากหัวกระดาษไม่ได้ — ใช้ตัวอ่านแบบทั่วไป"
WARN_NO_ACCOUNT = "อ่านเลขบัญชีจากหัวกระดาษไม่ได้ — ต้องระบุเองในหน้าตั้งค่าบัญชี"
WARN_NO_LINES = "ไม่พบบรรทัดรายการใน PDF — อาจเป็นไฟล์สแกนภาพ ต้องขอไฟล์ที่เป็นข้อความ"
WARN_PM_PREFIX = "ช่องทาง PM ที่พบ: "

# ---------------------------------------------------------------------------------------------
# fixed values: exception taxonomy (code, name, base severity, cause)
# ---------------------------------------------------------------------------------------------
MATCH_TYPES = [
    ("time_diff", "เวลาเกิน tolerance", "low", "เวลาระหว่างธนาคารกับระบบต่างกันเกินเกณฑ์"),
    ("missing_bo", "STM มากกว่า BO", "high", "รายการฝั่งระบบหลังบ้านหายไป"),
    ("missing_stm", "BO มากกว่า STM", "high", "auto ไม่เข้า แล้วทำ manual ซ้ำ"),
    ("amount_diff", "ยอดเงินไม่ตรง", "critical", "คีย์ยอดผิดจากต้นฉบับ"),
    ("cross_day", "รายการข้ามวัน (BO กับธนาคารคนละวัน)", "medium", "รายการค้างข้ามวันจากธนาคาร"),
    ("duplicate", "เติมซ้ำ / รายการซ้ำ", "critical", "ทำรายการซ้ำในระบบหลังบ้าน"),
    ("wrong_bank", "เลือกธนาคารผิด", "medium", "เลือกธนาคารผิดตอนกดอนุมัติ"),
    ("wrong_account", "ลูกค้าฝากผิดบัญชี", "medium", "ลูกค้าโอนเข้าบัญชีที่เลิกใช้"),
]
RULE_TYPES = [
    ("comm_cut_missing", "ค่าคอมสะสมเกิน ไม่มีรายการตัดยอด", "high", "อนุมัติถอนค่าคอมเกินสิทธิ์แต่ยังไม่ได้ตัดยอดส่วนเกิน"),
    ("comm_cut_mismatch", "ยอดตัดเครดิตไม่เท่ากับส่วนต่างค่าคอม", "critical", "คีย์ยอดตัดไม่ตรงกับส่วนต่างที่คำนวณได้"),
    ("credit_orphan", "ตัดเครดิตโดยไม่มีคำขอถอนค่าคอม", "high", "ตัดเครดิตด้วยเหตุอื่น ต้องมีเอกสารชี้แจงกำกับ"),
    ("credit_math", "ยอดเครดิตก่อน-หลัง ไม่สมดุล", "critical", "ยอดเครดิตในรายงานไม่สมดุล อาจแก้ไขหลังบันทึก"),
    ("bonus_math", "ยอดโบนัสก่อน-หลัง ไม่สมดุล", "high", "โปรโมชั่นคำนวณไม่ตรงกับยอดที่เติมจริง"),
    ("cross_day", "รายการข้ามวัน (BO กับธนาคารคนละวัน)", "medium", "ธนาคารบันทึกคนละวันกับระบบหลังบ้าน ต้องตรวจร่วมกับวันถัดไป"),
    ("duplicate", "เติมซ้ำ / รายการซ้ำ", "critical", "ทำรายการซ้ำในระบบหลังบ้าน"),
    ("large_amount", "ยอดสูงผิดปกติ ต้องมีเอกสารกำกับ", "medium", "ยอดสูงกว่าเกณฑ์ ต้องแนบเอกสารอนุมัติ"),
]
# fixed values: types listed in the configuration catalogue (code, name, base severity), in order
CATALOG_TYPES = [
    ("time_diff", "เวลาเกิน tolerance", "low"),
    ("missing_bo", "STM มากกว่า BO", "high"),
    ("missing_stm", "BO มากกว่า STM", "high"),
    ("amount_diff", "ยอดเงินไม่ตรง", "critical"),
    ("cross_day", "รายการข้ามวัน 23:00-23:59", "medium"),
    ("backdated", "เติมย้อนหลัง", "high"),
    ("wrong_bank", "เลือกธนาคารผิด", "medium"),
    ("wrong_account", "ลูกค้าฝากผิดบัญชี", "medium"),
    ("duplicate", "เติมซ้ำ / รายการซ้ำ", "critical"),
    ("unexplained_out", "ยอดโอนออกไม่มีชี้แจง", "critical"),
]
CAUSE_PENDING = "รอระบุสาเหตุ"
SLA_HOURS = [("critical", 4), ("high", 8), ("medium", 48), ("low", 72)]
SHIFTS = ["morning", "afternoon", "night"]
RULE_BREACH_TYPES = ["duplicate", "backdated", "cross_day", "wrong_bank", "wrong_account", "unexplained_out",
                     "missing_bo", "missing_stm"]
DIRECTION_DEPOSIT, DIRECTION_WITHDRAW, DIRECTION_OTHER = "ฝาก", "ถอน", "PM"
NO_STM_RAW = "— ไม่พบรายการฝั่ง STM ในช่วงเวลาที่ตรวจ —"
NO_BO_RAW = "— ไม่พบรายการฝั่ง BO ในช่วงเวลาที่ตรวจ —"
RULE_STM_RAW = "— ตรวจจากรายงานหลังบ้าน ไม่ต้องใช้ statement —"
NO_EMPLOYEE = "ไม่ระบุ"

# fixed values: bank named in a slip text, and its aliases
SLIP_PATTERN = r"(?:จาก|ไป|from|to)\s*([A-Z]{2,6})?\s*[xX](\d{3,4})"
SLIP_BANK_ALIAS = {"KPLUS": "KBANK", "KK": "KKP"}

# ---------------------------------------------------------------------------------------------
# fixed values: file names, mail subjects, registry keywords
# ---------------------------------------------------------------------------------------------
STM_NAME = r"(?i)ฝาก\s*[-–—/]?\s*ถอน|ฝากถอน|statement|(^|[^A-Za-z0-9])stm([^A-Za-z0-9]|$)"
PDF_NAME = r"(?i)\.pdf$"
DOC_NAME = r"(?i)\.docx?$"
INGEST_KINDS = [
    ("รายงานบัญชี(ฝาก|ถอน)", "bo_main"), ("ฝากมือ.*เครดิต", "manual_credit"),
    ("(?i)ฝากมือ.*Payment", "manual_payment"), ("ฝากมือ.*โบนัส", "manual_bonus"),
    ("ขอถอนค่าคอม", "comm_req"), ("ถอนเครดิต", "credit_out"),
]
TRIGGER_PM_NAME = "(?i)AUTOPEER|CYBER|AZPAY|MYPAY|12PAY"
FIX_PM_NAME = "(?i)CYBER|CYNER|CBY"
EFFECTIVE_PM_NAME = "(?i)(ATP|AUTOPEER|AZPAY|12PAY|MYPAY|CYBER|CYNER|CBY|(^|[^A-Za-z])PM([^A-Za-z]|$))"
BO_NAME = "(?i)รายงานบัญชี(ฝาก|ถอน)|(^|[^A-Za-z])BO([^A-Za-z]|$)"
FILE_COMPANIES = [
    ("AT4", "AT4"), ("FR8", "FR8"), ("SK8", "SK8"), ("MR9", "MR9"), ("MC8", "MC8"), ("UR9", "UR9"), ("PS8", "PS8"),
    ("7M", "UFABET7M"), ("3XB", "3XB"), ("XXX", "XXX"),
]
FILE_COMPANY_BRAND = "(?i)UFABET7M"
FILE_COMPANY_SYS123 = r"(?i)SYS123|ระบบ\s*123"
SUBJECT_COMPANIES = ["3XB", "AT4", "SK8", "FR8", "MC8", "MR9", "AZ8", "CY8", "UFABET7M"]
SUPPLEMENT_WORD = "เพิ่มเติม"
RESERVED_COMPANIES = ["BO", "PM", "STM", "FWD", "BBL", "KBANK", "SCB", "KTB", "BAY", "GSB", "TTB", "LBK", "XXX", "SYS123"]
MAIL_SYSTEMS = [
    ("(?i)UFABET7M|(^|[^A-Za-z0-9])7M([^A-Za-z0-9]|$)", "UFABET7M"),
    ("(?i)XXX|(^|[^A-Za-z0-9])3XB([^A-Za-z0-9]|$)", "XXX"),
    (r"(?i)(ระบบ\s*)?123|(^|[^A-Za-z0-9])(SK8|AT4|FR8)([^A-Za-z0-9]|$)", "SYS123"),
]
MAIL_COMPANIES = [
    ("(?i)(^|[^A-Za-z0-9])3XB(ET)?([^A-Za-z0-9]|$)", "3XB"),
    ("(?i)(^|[^A-Za-z0-9])AT4([^A-Za-z0-9]|$)", "AT4"),
    ("(?i)(^|[^A-Za-z0-9])FR8([^A-Za-z0-9]|$)", "FR8"),
    ("(?i)(^|[^A-Za-z0-9])SK8([^A-Za-z0-9]|$)", "SK8"),
    ("(?i)(^|[^A-Za-z0-9])MR9([^A-Za-z0-9]|$)", "MR9"),
    ("(?i)(^|[^A-Za-z0-9])MC8([^A-Za-z0-9]|$)", "MC8"),
    ("(?i)(^|[^A-Za-z0-9])UR9([^A-Za-z0-9]|$)", "UR9"),
    ("(?i)(^|[^A-Za-z0-9])PS8([^A-Za-z0-9]|$)", "PS8"),
    ("(?i)UFABET7M|(^|[^A-Za-z0-9])7M([^A-Za-z0-9]|$)", "UFABET7M"),
]
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
READABLE_EXT = r"(?i)\.(xlsx|xlsm|xls|csv|txt|pdf)$"
INGEST_EXT = r"(?i)\.(xlsx|xlsm|xls|csv|txt|pdf|docx)$"
OS_JUNK = r"^__MACOSX|/\._|^\._|\.DS_Store$"
HONORIFIC = r"^(คุณ|นางสาว|นาง|นาย|น\.ส\.|น\.ส|ที่)"
BANK_KEYWORDS = {"scb": "SCB", "kb": "KBANK", "kbank": "KBANK", "ktb": "KTB", "bbl": "BBL", "gsb": "GSB",
                 "tmn": "TMN", "bay": "BAY", "lbk": "LBK", "krungsri": "BAY"}
PM_KEYWORDS = {"atp": "AUTOPEER", "autopeer": "AUTOPEER", "az": "AZPAY", "azpay": "AZPAY", "cby": "CYBERPLUS",
               "cyber": "CYBERPLUS", "cyberplus": "CYBERPLUS", "cynerplus": "CYBERPLUS", "12pay": "12PAY",
               "mypay": "MYPAY"}
REASON_PM_NO_SUBCO = "ไฟล์ PM ไม่มีชื่อบริษัทย่อยในชื่อไฟล์ (เพิ่มบริษัทย่อยในชื่อไฟล์)"
REASON_BANK_NO_NAME = "พบธนาคารแต่จับชื่อบัญชีไม่ได้"
REASON_UNKNOWN = "ระบุธนาคาร/ผู้ให้บริการจากชื่อไฟล์ไม่ได้"
KIND_SIDE = {"stm_pdf": "stm", "pm_statement": "stm", "bo_main": "bo", "manual_credit": "bo", "manual_payment": "bo",
             "manual_bonus": "aux", "comm_req": "aux", "credit_out": "aux"}
WORK_MIX = [
    ("STM / ฝาก-ถอนธนาคาร", ["stm_pdf"]), ("รายงาน BO", ["bo_main"]), ("PM / Payment", ["pm_statement"]),
    ("Manual / รายการพิเศษ", ["manual_credit", "manual_payment", "manual_bonus", "comm_req", "credit_out"]),
    ("ชี้แจง / ยังจำแนกไม่ได้", ["doc_clarify", "unknown"]),
]
LINK_HEADERS = {
    "name": "name", "ชื่อ": "name", "ชื่อลิงก์": "name", "url": "url", "link": "url", "ลิงก์": "url", "ลิ้งค์": "url",
    "category": "category", "หมวด": "category", "หมวดหมู่": "category", "linegroup": "group", "line": "group",
    "ห้อง": "group", "ห้องline": "group", "ที่มา": "group", "backupurl": "backup_url", "ลิงก์สำรอง": "backup_url",
    "สำรอง": "backup_url", "note": "note", "หมายเหตุ": "note",
}
DEFAULT_CATEGORY = "ทั่วไป"
NO_GROUP = "ไม่ระบุห้อง"
NO_SYSTEM = "ไม่ระบุระบบ"
TH_MONTHS = ["ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค."]
OUTAGE_REGIONAL = "ถูกบล็อกระดับ ISP"
OUTAGE_HOST = "เซิร์ฟเวอร์หรือผู้ให้บริการโฮสต์ล่ม"
OUTAGE_UNCLEAR = "ผิดปกติบางจุดตรวจ ยังสรุปสาเหตุไม่ได้"
RISK_HIGH, RISK_MID, RISK_LOW = "สูง", "กลาง", "ต่ำ"
CLOSED_STATES = ["closed", "approved"]
