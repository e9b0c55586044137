"""Domain vocabulary as data. All of it can be replaced by the caller; this bundle is the default."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: trust of a source type
TRUST = {"scientific_article": 5, "patent": 4, "internal_report": 4, "conference_paper": 4, "journal_issue": 4, "review": 4, "lab_journal": 3, "unverified": 1}
# fixed values: top folder to (category, source type)
CATEGORIES = {
    "Статьи": ("article", "scientific_article"),
    "Обзоры": ("review", "review"),
    "Доклады": ("report", "internal_report"),
    "Журналы": ("journal", "journal_issue"),
    "Материалы конференций": ("conference", "conference_paper"),
}
# fixed values: canonical term and its aliases
SYNONYMS = {
    "электроэкстракция": ["electrowinning", "электролиз", "electroextraction"],
    "выщелачивание": ["leaching", "кучное выщелачивание", "heap leaching"],
    "флотация": ["flotation", "пенная флотация", "froth flotation"],
    "плавка": ["smelting", "печь взвешенной плавки", "flash smelting"],
    "обжиг": ["roasting", "calcination"],
    "обогащение": ["beneficiation", "mineral processing", "concentration"],
    "сорбция": ["sorption", "adsorption", "ионный обмен", "ion exchange"],
    "экстракция": ["solvent extraction", "жидкостная экстракция"],
    "цементация": ["cementation", "осаждение"],
    "очистка": ["purification", "treatment", "водоочистка"],
    "обессоливание": ["desalination", "demineralization", "опреснение"],
    "фильтрация": ["filtration", "сгущение", "thickening"],
    "сушка": ["drying", "обезвоживание"],
    "измельчение": ["grinding", "crushing", "дробление"],
    "агломерация": ["agglomeration", "окомкование", "pelletizing"],
    "брикетирование": ["briquetting"],
    "никель": ["nickel", "ni"],
    "медь": ["copper", "cu"],
    "кобальт": ["cobalt", "co"],
    "золото": ["gold", "au"],
    "серебро": ["silver", "ag"],
    "платина": ["platinum", "pt"],
    "палладий": ["palladium", "pd"],
    "железо": ["iron", "fe"],
    "цинк": ["zinc", "zn"],
    "свинец": ["lead", "pb"],
    "хром": ["chromium", "cr"],
    "литий": ["lithium", "li"],
    "сульфат": ["sulfate", "сульфаты"],
    "хлорид": ["chloride", "хлориды"],
    "гипс": ["gypsum", "техногенный гипс"],
    "католит": ["catholyte"],
    "анолит": ["anolyte"],
    "штейн": ["matte", "медный штейн", "никелевый штейн"],
    "шлак": ["slag"],
    "шихта": ["charge", "feed"],
    "концентрат": ["concentrate"],
    "хвосты": ["tailings"],
    "электролизная ванна": ["electrowinning cell", "электролизер"],
    "печь взвешенной плавки": ["flash smelting furnace", "пвп"],
    "конвертер": ["converter"],
    "мельница": ["mill", "grinding mill"],
    "флотомашина": ["flotation cell", "флотационная машина"],
    "ксантогенат": ["xanthate"],
    "цианид": ["cyanide"],
    "известь": ["lime", "cao"],
    "серная кислота": ["sulfuric acid", "h2so4"],
    "шахтные воды": ["mine water", "mine drainage"],
    "сточные воды": ["wastewater", "effluent"],
    "so2": ["сернистый газ", "sulfur dioxide"],
    "холодный климат": ["cold climate", "arctic", "крайний север"],
}
# fixed values: keywords of materials
MATERIALS = [
    "никель", "nickel", "медь", "copper", "кобальт", "cobalt", "золото", "gold", "серебро", "silver", "платина", "platinum", "палладий", "palladium", "железо", "iron", "цинк",
    "zinc", "свинец", "lead", "хром", "chromium", "литий", "lithium", "сульфид", "sulfide", "оксид", "oxide", "сульфат", "sulfate", "хлорид", "chloride", "гипс", "gypsum", "штейн",
    "matte", "шлак", "slag", "концентрат", "concentrate", "руда", "ore", "хвосты", "tailings", "католит", "catholyte", "анолит", "anolyte",
]
# fixed values: keywords of processes
PROCESSES = [
    "электроэкстракция", "electrowinning", "выщелачивание", "leaching", "флотация", "flotation", "плавка", "smelting", "обжиг", "roasting", "обогащение", "beneficiation",
    "сорбция", "sorption", "экстракция", "extraction", "цементация", "cementation", "очистка", "purification", "обессоливание", "desalination", "фильтрация", "filtration", "сушка",
    "drying", "измельчение", "grinding", "агломерация", "agglomeration", "брикетирование", "briquetting", "обеднение", "depletion",
]
# fixed values: keywords of equipment
EQUIPMENT = [
    "ванна", "cell", "печь", "furnace", "конвертер", "converter", "мельница", "mill", "флотомашина", "электролизер", "reactor", "диафрагма", "diaphragm", "насос", "pump",
]
# fixed values: keywords of parameters
PARAMETERS = [
    "температура", "temperature", "скорость", "velocity", "speed", "flow rate", "концентрация", "concentration", "давление", "pressure", "плотность", "density", "напряжение", "voltage",
    "ток", "current", "ph", "расход", "производительность", "capacity", "выход", "recovery", "извлечение", "степень", "efficiency", "кпд",
]
# fixed values: units
UNITS = [
    "мг/л", "mg/l", "мг/дм³", "г/л", "g/l", "%", "°c", "°с", "м/с", "m/s", "л/мин", "l/min", "м³/ч", "m³/h", "т/сут", "t/day", "bar", "атм", "в", "v", "а", "a", "ка", "ka", "мс",
    "ms", "с", "мин", "ч", "руб/м³", "руб/т", "$/t", "usd/t", "моль/л", "mol/l",
]
# fixed values: markers of home sources
HOME = ["росс", "russia", "норильск", "норникель", "nornickel", "жкз", "комсомольский", "надежда", "заполярный", "талнах", "рудник", "шахта", "цвметмет", "цветные металлы"]
# fixed values: markers of foreign sources
FOREIGN = [
    "australia", "австралия", "canada", "канада", "chile", "чили", "new caledonia", "новая каледония", "finland", "финляндия", "china", "китай", "japan", "япония",
    "usa", "сша", "zambia", "замби", "congo", "конго",
]
# fixed values: line beginnings that no title has
NO_TITLE = ["www.", "http", "issn", "doi", "удк", "ббк", "©", "издается", "ежемесячный", "научно-технический"]


@dataclass(frozen=True)
class Lexicon:
    """Keywords by entity type (in the order in which they win), aliases and units."""

    keywords: dict[str, list[str]] = field(default_factory=lambda: {"Material": MATERIALS, "Process": PROCESSES, "Equipment": EQUIPMENT, "Parameter": PARAMETERS})
    synonyms: dict[str, list[str]] = field(default_factory=lambda: SYNONYMS)
    units: list[str] = field(default_factory=lambda: UNITS)

    @property
    def aliases(self) -> dict[str, str]:
        """Lower-case alias or canonical term to canonical term; later entries win."""
        out: dict[str, str] = {}
        for canonical, names in self.synonyms.items():
            out |= {n.lower(): canonical for n in (canonical, *names)}
        return out

    def canonical(self, term: str) -> str:
        return self.aliases.get(term.strip().lower(), term.strip())


DEFAULT = Lexicon()
