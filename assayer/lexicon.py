"""Word lists that results depend on. Every function that uses one takes it as a parameter too."""

from __future__ import annotations

#: Verbs that a bullet may open with.
ACTION_VERBS = tuple(
    """
    achieved adapted added administered advanced analysed analyzed answered applied architected assembled
    assessed audited authored automated balanced built calculated centralised centralized clarified coached
    collaborated compiled completed composed computed conducted configured consolidated constructed consulted
    converted coordinated created cut debugged decreased defined delivered demonstrated deployed designed
    detected determined developed devised diagnosed directed documented doubled drafted drove earned edited
    eliminated enabled engineered enhanced established evaluated executed expanded expedited explained
    extended facilitated finalised finalized forecast formed formulated founded generated guided handled
    headed identified implemented improved increased influenced initiated innovated inspected installed
    instituted integrated interpreted introduced invented investigated launched led leveraged maintained
    managed mapped marketed measured mentored merged migrated minimised minimized modeled modelled modernised
    modernized monitored negotiated operated optimised optimized orchestrated organised organized overhauled
    oversaw performed pioneered planned prepared presented prioritised prioritized processed produced
    programmed proposed prototyped published queried raised rationalised rationalized rebuilt received
    recommended reconciled recorded recovered redesigned reduced refactored refined reorganised reorganized
    repaired replaced reported researched resolved restored restructured revamped reviewed revised scaled
    scheduled secured selected shipped simplified solved sourced spearheaded specified standardised
    standardized streamlined strengthened structured studied supervised supported surveyed sustained
    synthesised synthesized tested tracked trained transformed translated troubleshot uncovered unified
    updated upgraded validated verified wrote
    """.split()
)

#: Padding.
WEAK_PHRASES = (
    "responsible for", "duties included", "tasked with", "helped with", "worked on", "assisted with", "involved in", "participated in", "was part of",
    "in charge of", "hard working", "hard-working", "team player", "detail oriented", "go-getter", "think outside the box", "results-driven",
    "self-motivated", "various tasks", "etc.",
)

#: Misspellings and what is meant.
MISSPELLINGS = {
    "acheive": "achieve", "acheived": "achieved", "accomodate": "accommodate", "accomodated": "accommodated", "adn": "and", "buisness": "business",
    "calender": "calendar", "catagory": "category", "collaberated": "collaborated", "colaborated": "collaborated", "comminication": "communication",
    "communiction": "communication", "definately": "definitely", "developement": "development", "enviroment": "environment",
    "enviroments": "environments", "experiance": "experience", "goverment": "government", "immediatly": "immediately", "independant": "independent",
    "intergrated": "integrated", "knowlege": "knowledge", "langauge": "language", "langauges": "languages", "liason": "liaison",
    "maintainance": "maintenance", "maintainence": "maintenance", "managment": "management", "mangement": "management", "neccessary": "necessary",
    "necesary": "necessary", "nessesary": "necessary", "occassion": "occasion", "occassionally": "occasionally", "occured": "occurred",
    "occuring": "occurring", "oppurtunity": "opportunity", "particpated": "participated", "perfomance": "performance", "performace": "performance",
    "personel": "personnel", "priviledge": "privilege", "proffesional": "professional", "profesional": "professional", "refered": "referred",
    "relevent": "relevant", "responsibilites": "responsibilities", "responsibilty": "responsibility", "responsiblity": "responsibility",
    "recieve": "receive", "recieved": "received", "seperate": "separate", "seperated": "separated", "seperately": "separately", "sucess": "success",
    "sucessful": "successful", "sucessfully": "successfully", "succesful": "successful", "succesfully": "successfully", "teh": "the",
    "tommorow": "tomorrow", "truely": "truly", "untill": "until", "usefull": "useful", "wich": "which", "writting": "writing", "pyhton": "Python",
    "phyton": "Python", "javscript": "JavaScript", "javasript": "JavaScript", "kubernets": "Kubernetes", "kubernates": "Kubernetes",
    "postgress": "PostgreSQL",
}

#: Official spellings.
TECHNOLOGY_CASING = tuple(
    """
    JavaScript TypeScript Node.js Next.js GitHub GitLab MySQL PostgreSQL SQLite MongoDB Kubernetes Kafka Redis
    Python Java Django Flask FastAPI TensorFlow PyTorch NumPy Jupyter Linux Ubuntu macOS iOS Android GraphQL
    Tailwind Figma Jenkins Terraform Ansible Selenium Firebase Supabase Vue Svelte Kotlin Scala MATLAB Tableau
    PowerPoint
    """.split()
)

#: Wordings of a mandatory requirement.
MUST_CUES = (
    "required", "require", "must have", "must be", "must possess", "essential", "mandatory", "minimum", "at minimum", "you must", "candidates must",
    "necessary", "non-negotiable", "critical",
)

#: Wordings of an optional one.
NICE_CUES = (
    "preferred", "nice to have", "nice-to-have", "a plus", "plus if", "bonus", "desirable", "desired", "ideally", "would be great", "advantageous",
    "beneficial", "good to have", "we would love", "not required", "not necessary", "no ", "optional",
)

#: Wordings between the two.
STRONG_CUES = (
    "strongly preferred", "highly preferred", "strongly desired", "should have", "expected", "looking for", "we expect", "important",
)

#: Wordings that say a requirement does not apply.
NEGATIONS = (
    "not required", "not a requirement", "is not necessary", "no need", "not expected", "do not need", "don't need", "not looking for", "without",
    "no prior", "no formal",
)

#: Headings whose content is never a requirement.
BOILERPLATE_HEADINGS = (
    "about us", "about the company", "about our company", "who we are", "our mission", "our values", "our culture", "company overview", "benefits",
    "perks", "what we offer", "compensation", "salary", "pay range", "total rewards", "why join", "why work", "equal opportunity", "equal employment",
    "eeo", "diversity", "diversity and inclusion", "accommodations", "accessibility statement", "how to apply", "application process", "to apply",
    "next steps", "legal", "privacy", "disclaimer", "note to recruiters", "agency notice", "recruitment agencies",
)

#: Phrases that mark a block as boilerplate.
BOILERPLATE_PHRASES = (
    "equal opportunity employer", "without regard to race", "reasonable accommodation", "protected veteran", "applicants will receive consideration",
    "e-verify", "background check", "drug screening", "unsolicited resumes", "staffing agencies", "we are unable to respond",
    "due to the volume of applications", "no visa sponsorship", "click apply", "apply now", "submit your resume", "applications sent by email",
)

#: Words of a list of perks.
BENEFIT_WORDS = (
    "401(k)", "401k", "dental", "vision", "medical insurance", "health insurance", "paid time off", "pto", "parental leave", "maternity", "paternity",
    "free lunch", "snacks", "gym", "wellness", "stipend", "equity", "stock options", "pension", "life insurance", "sick leave", "holidays",
)

#: Headings by section.
HEADINGS = {
    "summary": ("summary", "professional summary", "career summary", "profile", "professional profile", "about", "about me", "objective", "career objective", "overview", "introduction", "who i am",),
    "experience": ("experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history", "positions", "professional background", "relevant experience", "industry experience", "internships", "internship experience", "where i worked", "where ive worked", "work",),
    "education": ("education", "academic background", "academics", "qualifications", "academic qualifications", "educational background", "schooling", "degrees", "education and training",),
    "skills": ("skills", "technical skills", "core skills", "key skills", "competencies", "core competencies", "technologies", "tech stack", "toolkit", "my toolkit", "tools", "expertise", "areas of expertise", "proficiencies", "technical proficiencies", "skills and tools",),
    "projects": ("projects", "personal projects", "side projects", "key projects", "selected projects", "academic projects", "portfolio", "things i built", "things ive built", "what i built", "work samples",),
    "certifications": ("certifications", "certificates", "licenses", "licences", "professional certifications", "credentials", "courses", "relevant coursework", "coursework", "training",),
    "awards": ("awards", "honors", "honours", "achievements", "accomplishments", "awards and honors", "recognition", "scholarships",),
    "publications": ("publications", "papers", "research", "research experience", "conference papers", "patents",),
    "volunteer": ("volunteer", "volunteering", "volunteer experience", "community", "community involvement", "extracurricular", "extracurricular activities", "activities", "leadership", "positions of responsibility",),
    "languages": ("languages", "language proficiency", "languages known",),
    "interests": ("interests", "hobbies", "hobbies and interests", "personal interests",),
    "contact": ("contact", "contact details", "contact information", "details",),
}

#: Frequent English words.
ENGLISH_MARKERS = tuple(
    """
    and the for with from that this using used to of in on at by as an a is was were developed built managed
    led designed team experience skills education project work
    """.split()
)

#: Fonts that every reader has.
SAFE_FONTS = tuple(
    """
    arial helvetica times calibri cambria garamond georgia verdana tahoma trebuchet courier roboto opensans
    lato liberation dejavu nimbus freesans freeserif sans-serif serif
    """.split()
)

#: Words that no name contains.
NOT_A_NAME = tuple(
    """
    resume curriculum vitae cv profile summary contact engineer developer analyst manager intern student
    designer consultant scientist experience education skills objective phone email address
    """.split()
)
