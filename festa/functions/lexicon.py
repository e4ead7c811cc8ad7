"""Word lists, gazetteer and patterns of the domain; all phrases are in normalised form (see text.normalize)."""

# Phrases that decide results. They are parameters of the engine, not code.

#: Phrases that mark a festival, show, fair or holiday by themselves.
STRONG = (
    "le hoi", "festival", "dai nhac hoi", "nhac hoi", "concert", "liveshow", "live show", "phao hoa", "countdown",
    "hoi cho", "trien lam", "marathon", "giai chay", "via ba", "cung dinh", "le cung", "ok om bok",
    "chol chnam thmay", "sen dolta", "dua ghe", "dua bo", "dua thuyen", "hoi dua", "giao thua", "chao nam moi",
    "carnival", "lien hoan", "tuan le van hoa", "tuan le du lich", "dem nhac", "dem hoi", "khai hoi", "le roc",
    "vu lan", "trung thu", "tet nguyen dan", "ngay hoi", "ngay hoi van hoa", "gala", "chuong trinh nghe thuat",
    "dem nghe thuat", "le dang huong", "hoi xuan", "hoi hoa", "dai le", "cho hoa", "duong hoa",
    "ooc om boc", "sene dolta", "don ta", "sen don ta", "cung ong ba", "ky yen", "nghinh ong", "cau ngu", "le via",
    "via ba", "le hoi dinh", "cung dinh", "le cung dinh", "le ha dien", "gio to", "le hoi chua", "le hoi den",
    "le hoi mieu", "hoi dinh", "le thanh minh", "le vu lan", "nghi le", "ky nghi le", "dip le", "dip tet", "don tet",
    "quoc khanh", "gio to hung vuong", "tet duong lich", "tet trung thu", "tet am lich", "tet doan ngo",
)
#: Phrases that count only together with a sign of a large crowd.
WEAK = (
    "khai mac", "be mac", "su kien", "hoi thi", "hoi dien", "tuan le", "bieu dien", "tranh tai", "giai dau",
    "giai the thao", "giai vo dich", "le ky niem", "khai truong", "mung dang", "ngay chay", "hoi thao",
    "ky nghi", "hoi nghi", "hoi thao", "dien dan", "san bay", "cang bien", "khu du lich",
)
#: Phrases in a title that rule an article out.
NEGATIVE = (
    "tai nan", "tu vong", "khoi to", "bat giu", "lua dao", "chung khoan", "gia vang", "ngoai hang anh",
    "premier league", "champions league", "hoi thao khoa hoc", "tong ket", "so ket", "ky hop", "dai hoi dang",
    "dai hoi dai bieu", "dai hoi cong doan", "tap huan", "hoi thi tay nghe", "tu van vien", "phap luat",
    "chuyen doi so", "hoi dong nhan dan", "bau cu", "huan luyen", "dien tap", "cong an", "quan su",
    "sinh hoat chuyen de", "hoc tap", "bao cao vien", "tuyen truyen", "tuyen sinh", "thi tuyen", "ban giao",
    "ky ket", "khoi cong", "nguon luc", "phat trien kinh te", "nghi quyet", "chuong trinh hanh dong",
    "cong nghiep van hoa", "doi moi sang tao", "chuyen doi", "khoa hoc cong nghe", "cong bo quyet dinh",
    "trao quyet dinh", "kiem tra", "giam sat",
)
PREPARING = ("chuan bi", "san sang", "hoan tat", "khan truong", "tat bat")
BULLETIN = ("thoi su", "ban tin", "diem tin")
#: Places that strain networks; matched from their first word on.
SENSITIVE = (
    "san bay", "cang", "khu du lich", "quang truong", "san van dong", "nha thi dau", "pho di bo", "nui ba den",
    "nui sam", "phu quoc", "ben ninh kieu", "trung tam hoi cho", "ben xe", "cong vien",
)
MIDDLE = (
    "le hoi", "hoi cho", "trien lam", "marathon", "giai chay", "via ba", "ok om bok", "chol chnam thmay",
    "sen dolta", "khai mac", "festival", "le ky niem", "dua ghe", "dua bo", "giao thua", "tet", "ky yen",
    "nghinh ong", "cau ngu", "le via", "cung dinh", "gio to", "vu lan", "nghi le", "quoc khanh", "hoi nghi",
    "dien dan",
)
TRADITIONAL = (
    "ooc om boc", "kate", "dieu tri cung", "trung thu", "trang ram", "via ba", "ba chua xu", "ok om bok",
    "chol chnam thmay", "sen dolta", "ky yen", "nghinh ong", "cau ngu", "cung dinh", "le via", "gio to", "vu lan",
    "le hoi dinh", "le hoi chua", "le hoi den", "le hoi mieu", "le dang huong", "le roc", "dua ghe", "dua bo",
    "hoi dua", "le ha dien", "le thanh minh", "nguyen trung truc", "nguyen dinh chieu", "thoai ngoc hau",
    "tran hung dao", "ba den", "quan the am", "nguyen huu canh", "le van duyet", "ong dia", "ba thien hau",
    "quan de", "le hoi nghinh",
)
#: Words that don't tell events apart.
COMMON = (
    "le", "hoi", "tai", "cua", "va", "cac", "nam", "lan", "thu", "tinh", "thanh", "pho", "khai", "mac", "to", "chuc",
    "dien", "ra", "se", "la", "co", "cho", "voi", "trong", "tu", "den", "ngay", "sap", "dau", "hon", "nguoi",
    "khoang", "du", "kien",
)
#: Provinces in ranking order: key, shown name, aliases.
PROVINCES = {
    "hcm": ("TP. Hồ Chí Minh", ("tp hcm", "tphcm", "hcmc", "tp ho chi minh", "thanh pho ho chi minh", "sai gon", "thu duc", "can gio", "binh duong", "thu dau mot", "vung tau", "ba ria", "long hai", "ho tram")),
    "dongnai": ("Đồng Nai", ("dong nai", "bien hoa", "long thanh", "nhon trach", "binh phuoc", "dong xoai", "binh long")),
    "tayninh": ("Tây Ninh", ("tay ninh", "nui ba den", "long an", "tan an", "kien tuong", "moc bai", "hoa thanh")),
    "angiang": ("An Giang", ("an giang", "chau doc", "long xuyen", "nui sam", "ha tien", "kien giang", "rach gia", "phu quoc", "tri ton", "nui cam", "tinh bien", "kien luong", "bay nui", "that son", "tan chau", "an phu", "thoai son", "chau phu")),
    "dongthap": ("Đồng Tháp", ("dong thap", "cao lanh", "sa dec", "tien giang", "my tho", "go cong", "cai be", "tram chim", "vinh trang")),
    "vinhlong": ("Vĩnh Long", ("vinh long", "ben tre", "tra vinh")),
    "cantho": ("Cần Thơ", ("can tho", "ninh kieu", "soc trang", "hau giang", "vi thanh", "nga bay", "cai rang", "o mon")),
    "camau": ("Cà Mau", ("ca mau", "bac lieu", "nam can", "dat mui")),
}
#: What users type besides names and aliases.
TYPED_NAMES = {"hcm": ("hcm", "sg", "tp hcm", "sai gon", "ho chi minh"), "tayninh": ("tn",), "cantho": ("ct",)}
#: Places outside the region; one that stands twice counts twice.
ELSEWHERE = (
    "ha noi", "hue", "da nang", "hai phong", "quang ninh", "nghe an", "thanh hoa", "da lat", "lam dong", "khanh hoa",
    "nha trang", "hoi an", "quang nam", "ninh binh", "lao cai", "gia lai", "dak lak", "quy nhon", "binh dinh",
    "quang tri", "ha long", "sa pa", "ha tinh", "cao bang", "lang son", "son la", "dien bien", "tuyen quang",
    "thai nguyen", "phu tho", "bac ninh", "hung yen", "quang ngai", "kon tum", "dong hoi", "vinh phuc", "hai duong",
    "nam dinh", "thai binh", "ha giang", "yen bai", "bac giang", "trung quoc", "campuchia", "thai lan", "nhat ban",
    "han quoc", "thang long", "hoang thanh", "hoan kiem", "ba dinh", "my dinh", "trung tam hoi nghi quoc gia",
    "tay ho", "cau giay", "hai ba trung", "long bien", "ha dong", "buon ma thuot", "pleiku", "co do hue", "thu do",
    "thu do ha noi", "hoa binh", "bac kan", "lai chau", "dak nong", "gia nghia", "ninh thuan", "phan rang",
    "binh thuan", "phan thiet", "mui ne", "cam ranh", "tam ky", "sam son", "cua lo", "tuy hoa", "bai chay", "cat ba",
    "tam dao", "mu cang chai", "phu yen", "kon tum", "ha nam", "phu ly", "tay bac", "tay nguyen", "mien bac",
    "mien trung", "bac bo", "trung bo", "dong bang song hong", "phnom penh", "singapore", "malaysia", "indonesia",
)
AT_WORDS = ("tai", "o", "len", "ra")
PLACE_PREFIXES = ("thanh pho", "tp", "tinh")
FESTIVAL_HEADS = ("ngay hoi", "le hoi", "festival", "tuan le", "hoi cho", "lien hoan", "ngay van hoa")
LOCAL_SITES = {
    "hcm": ("sggp.org.vn", "baobinhduong.vn", "baobariavungtau.com.vn", "hcmcpv.org.vn"),
    "dongnai": ("baodongnai.com.vn", "dnrtv.vn", "baobinhphuoc.com.vn"),
    "tayninh": ("baotayninh.vn", "baolongan.vn"),
    "angiang": ("baoangiang.com.vn", "angiang.gov.vn", "baokiengiang.vn"),
    "dongthap": ("baodongthap.vn", "dongthap.gov.vn", "baoapbac.vn"),
    "vinhlong": ("baovinhlong.com.vn", "baobentre.vn", "baotravinh.vn"),
    "cantho": ("baocantho.com.vn", "cantho.gov.vn", "baosoctrang.org.vn", "baohaugiang.com.vn"),
    "camau": ("baocamau.vn", "baobaclieu.vn"),
}
VENUE_STOPS = ("vào", "từ", "lúc", "ngày", "với", "để", "nhằm", "trong", "và", "do", "theo", "của", "sẽ", "đã", "đang", "có", "khi", "sau", "trước", "cùng", "nơi", "bởi", "như", "được")
VENUE_HEADS = ("Quảng", "Sân", "Công", "Nhà", "Bến", "Đình", "Chùa", "Miếu", "Khu", "Trường", "Hoàng", "Tòa", "Cảng", "Phố", "Cung", "Núi", "Hồ", "Đường", "Làng", "Đền", "Thánh", "Lăng", "Khách", "Chợ", "Bảo", "Di", "Ga", "Sảnh", "Vườn", "Biển", "Bãi", "Cầu", "Vinpearl", "Dinh", "Rạp")
NOT_VENUES = ("ho chi minh", "cong an", "ubnd", "uy ban", "quan doi", "bo chi huy")
VIETNAMESE_LETTERS = "ăđơưạảặẳẵậẩẫẹẻẽệểễịỉĩọỏộổỗợởỡụủũựửữỵỷỹầấằắềếồốờớừứ"
UNITS = {"nghìn": 1_000, "ngàn": 1_000, "triệu": 1_000_000, "vạn": 10_000}
WORD_CROWDS = {"chục nghìn": 20_000, "chục ngàn": 20_000, "vạn": 10_000, "trăm nghìn": 200_000, "trăm ngàn": 200_000, "triệu": 1_000_000}
PRIORITIES = {"CAO": "CAO", "TB": "TB", "THAP": "THẤP"}
WEEKDAYS = ("Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy", "Chủ Nhật")
END_MARKERS = ("related post", "bài viết liên quan", "tin liên quan", "tin cùng chuyên mục", "bình luận", "comments", "có thể bạn quan tâm", "tin mới nhất", "tin khác")
