"""Word lists of the sentence tagger: abbreviations by what follows them, and words that tell how a text goes on.

All lists are fixed values of common dictionaries of abbreviations and grammars. A word's kind is a feature of the model,
whose weights are learnt; a word that no list has is told by its shape.
"""

from __future__ import annotations

#: Abbreviations by language and kind: before a name, a number or a word; at the end of a list, after a quantity, months.
ABBREVIATIONS = {
    "en": {
        "title": "Dr. Prof. Mr. Mrs. Ms. St. Gen. Sen. Rev. Capt. Col. Lt. Sgt. Gov. Mt. Hon.",
        "ref": "No. Nos. Fig. Figs. Tab. Eq. Eqs. Sec. Vol. Ch. p. pp. Art. Ref. Ex. Pl. ca. approx. est. max. min.",
        "word": "e.g. i.e. cf. vs. viz. resp. std. dev. avg. incl. excl. var. ssp. cv.",
        "tail": "etc. al. Inc. Corp. Ltd. Co. Jr. Sr. Bros. Ave. Blvd. Rd. Dept. ed. eds.",
        "taxon": "sp. spp. subsp. gen.",
        "unit": "hr. hrs. ft. lb. lbs. oz. mi. yr. yrs.",
        "month": "Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec.",
        "hour": "a.m. p.m.",
    },
    "de": {
        "title": "Dr. Prof. Hr. Fr. Dipl. Ing. St.",
        "ref": "Nr. Abb. Tab. Bd. Kap. Abs. Art. S. ca. mind. max. min.",
        "word": "bzw. bzgl. vgl. ggf. inkl. exkl. evtl. sog. zzgl. z.B. d.h. u.a. i.d.R. o.ä.",
        "pair": "z. B.|d. h.|u. a.|i. d. R.",
        "tail": "usw. etc.",
        "month": "Jan. Feb. Aug. Sept. Okt. Nov. Dez.",
    },
    "fr": {
        "title": "M. MM. Mme. Mlle. Me. Dr.",
        "ref": "fig. p. n. art. vol. chap. env. max. min. éd.",
        "word": "cf. c.-à-d. p.ex. resp.",
        "pair": "p. ex.",
        "tail": "etc.",
        "month": "janv. févr. juil. sept. oct. nov. déc.",
    },
    "es": {
        "title": "Sr. Sra. Srta. Dr. Dra. Ud. Uds.",
        "ref": "fig. pág. págs. núm. art. vol. cap. aprox. máx. mín. tel. v.",
        "word": "cf. p.ej.",
        "pair": "p. ej.",
        "tail": "etc.",
        "month": "ene. feb. abr. ago. sept. oct. nov. dic.",
    },
    "it": {"title": "Sig. Dott. Ing. Avv.", "ref": "pag. fig. art. cap. n. ca.", "word": "cfr. es.", "tail": "ecc.", "month": "genn. febbr. ott. dic."},
    "pt": {"title": "Sr. Sra. Dr. Dra.", "ref": "pág. fig. art. cap. aprox.", "word": "cf. p.ex.", "tail": "etc.", "month": "jan. fev. set. out. dez."},
    "nl": {"title": "dhr. mevr. dr. prof.", "ref": "nr. blz. afb. ca. max.", "word": "bijv. o.a. d.w.z. m.b.t.", "tail": "enz.", "month": "jan. aug. okt. dec."},
    "pl": {"title": "dr. prof. inż.", "ref": "nr. str. rys. tab. ok. art.", "word": "np. tj. m.in.", "tail": "itd. itp.", "month": "sty. sie. gru."},
    "ru": {
        "title": "проф. др. им. ул. акад.",
        "ref": "рис. табл. стр. гл. п. ст. см. ок. №",
        "word": "напр. т.е.",
        "pair": "т. е.",
        "tail": "др. т.д. т.п.",
        "unit": "г. гг. тыс. млн. руб.",
        "tailpair": "т. д.|т. п.|и др.",
    },
    "ar": {"title": "د. أ.", "ref": "ص. ج. م.", "word": "مثلا."},
    "hi": {"title": "डॉ. श्री. प्रो.", "ref": "सं. पृ. क्र.", "unit": "से.मी. मि.मी. कि.मी. कि.ग्रा."},
}
#: Words that often begin a sentence and are no names: articles, pronouns, prepositions, connectives.
STARTERS = {
    "en": "The A An It He She We They I You This That These Those There In At On For But And So Yet If When While After Before Then Our His Her Its My No Not Some Many Each All What Who Why How Where Is Are Was Were Did Do Does Please",
    "de": "Der Die Das Ein Eine Es Er Sie Wir Ich Dies Diese Dieser In Im Am Auf Bei Nach Vor Für Aber Und Doch Wenn Als Dann Was Wer Wie Wo Nur Auch Kein Keine Ist War Hat",
    "fr": "Le La Les Un Une Des Il Elle Ils Elles Nous Vous On Ce Cette Ces Dans En Au Aux Pour Mais Et Si Quand Puis Que Qui Est",
    "es": "El La Los Las Un Una Ella Ellos Nosotros Este Esta En Al Para Pero Y Si Cuando Luego Que No Se Es",
    "it": "Il Lo La Gli Le Un Una Egli Ella Noi Questo Questa In Nel Per Ma E Se Quando Poi Che Non",
    "pt": "O A Os As Um Uma Ele Ela Nós Este Esta Em No Na Para Mas E Se Quando Depois Que Não",
    "nl": "De Het Een Hij Zij Ze Wij We Dit Deze Dat In Op Voor Maar En Als Toen Dan Wat Er",
    "pl": "Ten Ta To W Na Z Po Przed Ale I Gdy Kiedy Potem Co Nie Czy",
    "ru": "Он Она Они Мы Я Это Этот Эта В На Для После Но И Если Когда Потом Что Не Как Через По За",
}
#: Words after which a number with a stop is an ordinal or a day.
BEFORE_ORDINAL = "am der die das dem den des im vom zum zur ab bis seit jeder jede jedes"
#: Months and weekdays; after an hour or a day's number they go on.
CALENDAR = (
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "Januar Februar März Mai Juni Juli Oktober Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag"
)
#: Words that report a quotation.
REPORTING = (
    "said asked wrote replied added called cried shouted whispered answered explained warned noted says asks writes "
    "sagte fragte schrieb rief antwortete meinte erklärte dit demanda écrivit répondit cria demande "
    "dijo preguntó escribió respondió gritó disse chiese scrisse rispose perguntou escreveu zei vroeg schreef "
    "сказал сказала спросил спросила написал написала ответил ответила крикнул крикнула powiedział zapytał napisał"
)
#: Words and characters with which an interrupted sentence goes on, in scripts without letter case.
GOES_ON = {
    "cjk": ("但", "而", "却", "然", "就", "又", "也", "还", "可", "不过", "只是", "だが", "しかし", "けれど", "でも", "それ"),
    "arabic": ("و", "ثم", "لكن", "ولكن", "بل", "أو"),
    "deva": ("लेकिन", "पर", "और", "मगर", "फिर", "तो", "किंतु"),
}
#: Particles before which an interrupted Japanese sentence is not at its end.
PARTICLES = ("で", "が", "は", "を", "に", "て", "と", "も", "の", "けど", "ので", "から", "のに")
#: How Japanese and Chinese sentences end; text without stops is cut by what the model learns of their last characters.
ENDINGS = {
    "ja": ("です", "ます", "ました", "でした", "ません", "だった", "である", "でしょう", "ましょう", "ください", "ですか", "ますか"),
    "zh": ("了", "吗", "呢", "吧"),
}
