"""The words, phrases and patterns by which the parsers and rules read a text. Phrases are parted by |."""

# Heading phrases of each section kind with the confidence of an exact match.
SECTION_HEADINGS = {
    "summary": (0.9, "summary|professional summary|career summary|profile|professional profile|about|about me|objective|career objective|overview|introduction|highlights|career highlights|key qualifications|о себе|обо мне|краткая информация|резюме|профиль|цель|карьерная цель|кто я|коротко о себе|про меня"),
    "experience": (0.95, "experience|work experience|professional experience|employment|employment history|work history|career|career history|relevant experience|professional background|positions|опыт|опыт работы|профессиональный опыт|трудовой опыт|место работы|места работы|карьера|где я работал|где работал|работа|занятость"),
    "education": (0.95, "education|academic background|academic|qualifications|academic qualifications|degrees|образование|учеба|учёба|академическое образование|вуз|обучение"),
    "skills": (0.9, "skills|technical skills|hard skills|core skills|key skills|competencies|core competencies|technologies|tech stack|stack|technical expertise|expertise|tools|tools and technologies|toolbox|навыки|ключевые навыки|технические навыки|технологии|стек|стек технологий|инструменты|компетенции|знания|чем владею|с чем работаю"),
    "projects": (0.85, "projects|personal projects|side projects|selected projects|portfolio|pet projects|open source|open source contributions|проекты|личные проекты|пет-проекты|портфолио|избранные проекты"),
    "certifications": (0.9, "certifications|certificates|licenses|licenses and certifications|courses|training|professional development|сертификаты|сертификация|курсы|повышение квалификации|дополнительное образование|тренинги"),
    "languages": (0.9, "languages|language skills|языки|знание языков|иностранные языки"),
    "awards": (0.85, "awards|honors|honours|achievements|recognition|награды|достижения|признание"),
    "publications": (0.85, "publications|talks|conference talks|speaking|articles|patents|публикации|статьи|доклады|выступления|патенты"),
    "volunteering": (0.85, "volunteering|volunteer experience|community|community involvement|волонтерство|волонтёрство|общественная деятельность"),
    "interests": (0.8, "interests|hobbies|personal interests|outside work|интересы|хобби|увлечения"),
    "references": (0.9, "references|referees|рекомендации|рекомендатели"),
    "contacts": (0.85, "contact|contacts|contact information|contact details|get in touch|reach me|links|контакты|контактная информация|связаться|ссылки"),
}
#: Headings in the other languages of the tables, which the fixed list lacks.
OTHER_HEADINGS = {
    "summary": "kurzprofil|profil|über mich|perfil|resumo|résumé|sobre mí",
    "experience": "berufserfahrung|expérience|experiencia|experiência",
    "education": "ausbildung|formation|estudios|educación|formação|formación",
    "skills": "kenntnisse|compétences|conocimientos|competências",
    "references": "referenzen|références|referencias|referências",
}

# Words of job titles, of employers, of places of work, and what parts the pieces of a role's header.
TITLE_WORDS = "engineer|developer|programmer|architect|lead|manager|director|head|designer|analyst|scientist|consultant|specialist|administrator|devops|sre|qa|tester|intern|founder|cto|ceo|vp|owner|scrum master|team lead|tech lead|staff|principal|senior|middle|junior|fullstack|full stack|frontend|backend|разработчик|инженер|менеджер|аналитик|дизайнер|руководитель|тимлид|стажер|ведущий|старший"
COMPANY_MARKERS = "inc|inc.|llc|ltd|ltd.|gmbh|corp|corp.|co.|company|group|holding|bank|technologies|solutions|systems|labs|studio|agency|consulting|software|ооо|тоо|ао|зао|ип|банк|компания|группа"
WORKPLACE = "remote|hybrid|onsite|on-site|удаленно|удалённо|гибрид|офис"
HEADER_SEPARATOR = r"\s*[|•·—–]\s*|\s{3,}|\s+[-–—]\s+|,\s+"

# Domains of links by kind, personal details by kind, places, and title words of a header.
LINK_DOMAINS = (("linkedin", r"linkedin\.com"), ("github", r"github\.(?:com|io)"), ("gitlab", r"gitlab\.com"), ("telegram", r"(?:t\.me|telegram\.me)"), ("stackoverflow", r"stackoverflow\.com"), ("behance", r"(?:behance\.net|dribbble\.com)"))
LINK = r"(?:https?://|www\.)[^\s<>\",;)\]]+|(?:[\w-]+\.)+(?:com|io|dev|me|org|net|ru|kz)/[^\s<>\",;)\]]*"
SENSITIVE_WORDS = {
    "birthDate": "date of birth|dob|d.o.b.|born on|дата рождения|день рождения|год рождения",
    "maritalStatus": "marital status|married|divorced|семейное положение|женат|замужем|не женат|холост|разведен",
    "nationality": "nationality|citizenship|гражданство|национальность",
    "religion": "religion|вероисповедание|религия",
    "idNumber": "ssn|social security|passport|иин|инн|снилс|паспорт|удостоверение личности",
    "salaryExpectation": "salary expectation|salary expectations|expected salary|desired salary|желаемая зарплата|зарплатные ожидания|ожидаемый доход|ожидаемая зарплата",
}
_L, _R = r"(?:^|[^\p{L}\p{N}])", r"(?:$|[^\p{L}\p{N}])"
SENSITIVE_SHAPES = {
    "age": rf"{_L}(?:age\s*[:–-]?\s*\d{{2}}|\d{{2}}\s*years?\s*old|возраст\s*[:–-]?\s*\d{{2}}|\d{{2}}\s*(?:лет|года)){_R}",
    "gender": rf"{_L}(?:gender|sex|пол)\s*[:–-]",
    "fullHomeAddress": rf"{_L}(?:ул\.|улица|квартира|кв\.\s*\d|дом\s*\d|apt\.?\s*\d|apartment\s*\d|\d+\s+(?:street|st\.|avenue|ave\.|road|rd\.))",
}
HIGH_RISK = ("photo", "birthDate", "age", "maritalStatus", "gender", "religion")
PLACES = "almaty|astana|nur-sultan|shymkent|karaganda|moscow|saint petersburg|tbilisi|yerevan|bishkek|tashkent|dubai|berlin|amsterdam|london|warsaw|lisbon|remote|relocation|алматы|астана|москва|удаленно|релокация"
HEADER_TITLES = "engineer|developer|manager|designer|analyst|lead|architect|consultant|specialist|разработчик|инженер|менеджер|аналитик|дизайнер|руководитель"
HEADLINE_TITLES = HEADER_TITLES + "|scientist|qa|sre|devops|product owner|scrum master|тимлид|тестировщик"

# Schools, degrees in the order of their test, fields of study, certificates, and languages with their names and levels.
SCHOOLS = "university|institute|college|school|academy|polytechnic|universität|universidad|университет|институт|академия|колледж|училище|школа"
DEGREES = (
    ("PhD", "phd|ph.d|doctorate|аспирантура|кандидат наук|доктор наук"),
    ("Master's", "msc|m.sc|master|masters|master's|ma|магистр|магистратура"),
    ("MBA", "mba"),
    ("Bachelor's", "bsc|b.sc|bachelor|bachelors|bachelor's|ba|бакалавр|бакалавриат"),
    ("Specialist", "специалист|специалитет|specialist degree"),
    ("Associate", "associate|associate's|среднее специальное|колледж"),
)
STUDY_FIELD = rf"(?i){_L}(?:major|faculty|specialt?y|field of study|специальность|факультет|направление|кафедра)\s*[:–-]?\s+(.+)"
CERTIFICATES = "certified|certificate|certification|coursera|udemy|udacity|pluralsight|aws certified|microsoft certified|google cloud certified|сертификат|сертификация|удостоверение|свидетельство"
LANGUAGE_NAMES = {"English": "english|английский", "Russian": "russian|русский", "Kazakh": "kazakh|казахский", "German": "german|немецкий", "French": "french|французский", "Spanish": "spanish|испанский", "Chinese": "chinese|китайский", "Turkish": "turkish|турецкий", "Arabic": "arabic|арабский"}
LEVELS = "native|fluent|advanced|upper-intermediate|upper intermediate|intermediate|pre-intermediate|elementary|basic|beginner|родной|свободный|продвинутый|средний|базовый|начальный"

# Verbs of results.
ACTION_VERBS = "achieved|accelerated|boosted|cut|delivered|doubled|drove|eliminated|exceeded|generated|grew|improved|increased|maximized|minimized|optimized|reduced|saved|scaled|streamlined|tripled|architected|authored|built|created|designed|developed|engineered|established|founded|implemented|introduced|launched|migrated|modernized|prototyped|rebuilt|refactored|shipped|coached|coordinated|directed|facilitated|guided|hired|led|managed|mentored|onboarded|orchestrated|owned|spearheaded|supervised|analyzed|audited|benchmarked|diagnosed|evaluated|forecast|identified|investigated|measured|researched|resolved|troubleshot|validated|aligned|collaborated|consolidated|negotiated|partnered|presented|published|standardized|автоматизировал|внедрил|вывел|выстроил|добился|запустил|значительно|изменил|консолидировал|масштабировал|мигрировал|модернизировал|настроил|оптимизировал|организовал|основал|перевёл|перевел|переписал|повысил|подготовил|построил|провёл|провел|разработал|реализовал|сократил|создал|снизил|спроектировал|ускорил|устранил|увеличил|улучшил|внедрила|запустила|разработала|создала|сократила|улучшила"

# The narrator in the first person, the passive, and amounts. FIRST_I is tested as written, the others in lower case.
FIRST_I = rf"{_L}I\s+(?:was|am|have|had|led|built|created|managed|developed|worked|did){_R}"
FIRST_PERSON = (
    rf"{_L}my\s+(?:role|responsibilities|team|job|work|task){_R}",
    rf"{_L}we\s+(?:built|created|developed|delivered|launched){_R}",
    rf"{_L}я\s+(?:был|была|работал|работала|сделал|сделала|занимался|занималась|разработал|разработала){_R}",
    rf"{_L}мо(?:й|я|и|ей|его)\s+(?:роль|обязанност|команд|задач|работ)",
    rf"{_L}мы\s+(?:сделали|создали|разработали|запустили|внедрили){_R}",
)
PASSIVE = (
    rf"{_L}(?:was|were|is|are|been|being)\s+\p{{L}}+(?:ed|en){_R}",
    rf"{_L}(?:has|have|had)\s+been\s+\p{{L}}+(?:ed|en){_R}",
    rf"{_L}был[аио]?\s+\p{{L}}+(?:н|т)[аоые]*{_R}",
    rf"{_L}\p{{L}}+(?:лось|лись|ется|ются|ался|ались){_R}",
)
AMOUNTS = (
    r"\d+\s*%",
    rf"[$€₽₸£¥]\s*\d|\d+\s*(?:\$|€|₽|₸|(?:k|m|млн|тыс|млрд){_R})",
    rf"{_L}\d+(?:[.,]\d+)?\s*(?:x|х){_R}",
    rf"{_L}(?:from|to|с|до)\s+\d+",
    rf"{_L}\d{{2,}}{_R}",
    rf"{_L}(?:doubled|tripled|halved|удвоил|утроил){_R}",
)

# Levels of seniority by title, in the order of their test (roles), and by a vacancy's head.
SENIORITY_TITLES = (
    ("junior", "junior|jr.|intern|trainee|entry level|джуниор|стажер|стажёр|младший"),
    ("middle", "middle|mid-level|engineer ii|specialist|мидл|специалист"),
    ("senior", "senior|sr.|staff|engineer iii|сеньор|старший|ведущий"),
    ("lead", "lead|team lead|tech lead|principal|head of|director|architect|manager|cto|vp of|руководитель|тимлид|начальник|директор|архитектор"),
)
VACANCY_SENIORITY = (
    ("lead", "lead|principal|staff|head of|director|architect|тимлид|руководитель|ведущий|архитектор"),
    ("senior", "senior|sr|сеньор|старший"),
    ("junior", "junior|jr|intern|trainee|джуниор|стажер|стажёр|младший"),
    ("middle", "middle|mid-level|мидл"),
)
VACANCY_TITLES = "engineer|developer|designer|manager|analyst|architect|scientist|lead|specialist|разработчик|инженер|аналитик|дизайнер|менеджер|руководитель|тестировщик"
VACANCY_HEADINGS = {
    "optional": "nice to have|nice-to-have|would be a plus|bonus|bonus points|preferred|desirable|optional|advantage|будет плюсом|будет преимуществом|желательно|приветствуется|не обязательно",
    "required": "requirements|required|must have|must-have|qualifications|what you need|what we expect|you have|skills|hard skills|ожидания|требования|обязательные требования|что мы ждем|что мы ждём|вы подходите|необходимые навыки|ключевые навыки",
    "responsibilities": "responsibilities|what you will do|what you'll do|your role|about the role|duties|обязанности|задачи|чем предстоит заниматься|что делать",
}

# Abbreviations and what they stand for, work abroad, legal forms of one country, and industries.
EXPANSIONS = (("ci/cd", "continuous integration"), ("tdd", "test driven development"), ("bdd", "behaviour driven development"), ("a11y", "accessibility"), ("k8s", "kubernetes"), ("ml", "machine learning"), ("ux", "user experience"), ("qa", "quality assurance"))
WORK_ABROAD = "relocation|relocate|remote|visa|work permit|sponsorship|eligible to work|релокация|релокации|переезд|удаленно|удалённо|виза"
LOCAL_FORMS = "тоо|ооо|ао|зао|ип|ргп|гу"
INDUSTRIES = "bank|fintech|retail|telecom|marketplace|logistics|банк|финтех|ритейл|телеком|маркетплейс|логистик"
