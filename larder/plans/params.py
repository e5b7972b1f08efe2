"""Parameters of the registered queries (chosen to hit rows at every scale)."""

NOW = "2001-08-02 00:00:00"        # after the last receipt of the driver data
TODAY = "2001-01-10"                # promotion pass day (expiry dates are 2001-01-01..30)
AGE_TODAY = "1988-01-05"            # age-rule day: some employees are not yet 18
START, MID, END = "1996-01-01", "1996-04-01", "1996-12-31"
DAY = "1997-11-01"

ROLE = "Cashier"
EMPLOYEE_SURNAME = "Supplier#000000003"
EMPLOYEE_ID = "3"
PERCENT = 3
CUSTOMER_SURNAME = "Customer#000000007"
CASHIER, CASHIER2 = "1", "2"
CHECK = "42"
PRODUCT_ID = 42
PRODUCT_NAME = "red plate"
UPC = "000000000042"
CATEGORY_NAME = "Brand#7"
SEARCH, SEARCH2 = "ring", "plate"
MIN_PRICE, MAX_PRICE = 910, 950
CATEGORIES = [1, 2, 3, 4, 5]
STOCK_BOUND = 9000
DUP_CHECK = "3"                     # its sale lines are appended twice in the unique-key check
NEW_CARD_SEGMENT = "BUILDING"       # new cards issued to this market segment
RICH_BALANCE = 9900                 # these customers' existing cards are issued again
UPDATE_SEGMENT, ZERO_SEGMENT, UNKNOWN_SEGMENT = "AUTOMOBILE", "HOUSEHOLD", "MACHINERY"
PURGE_BEFORE = "1995-07-01"         # receipts older than this are deleted
SPARE_CATEGORY = 999
REKEY_CATEGORY = 1
NEW_PRODUCT_CATEGORY = 1            # new products (one per distinct part name) go here
PRICE_UP_CATEGORY = 2               # these items get 10 % dearer
ZERO_PRICE_SIZE = 50                # items of parts of this size are (wrongly) priced 0
