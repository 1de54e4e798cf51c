"""Word lists used by the text operators.

Stop-word lists, language profiles and the sentiment lexicon are *inputs*:
every operator accepts a user table instead. The seeds below are the
defaults shipped with the library.
"""

from __future__ import annotations

# English stop words (the widely used NLTK English list).
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Indonesian stop-word seed list of the reference analyser.
INDONESIAN_STOPWORDS = (
    "yang dan di ke pada untuk dengan adalah ini itu tersebut dari sebagai dalam akan telah juga atau "
    "karena jika seperti oleh bisa dapat yaitu yakni"
).split()

# The basic stop list of the simple keyword extractor.
BASIC_STOPWORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did "
    "will would could should may might must can this that these those i you he she it we they me him "
    "her us them my your his its our their"
).split()

# Common function words of French, German and Spanish (own seed lists).
FRENCH_STOPWORDS = (
    "au aux avec ce ces cet cette dans de des du elle elles en et eux il ils je la le les leur leurs lui ma mais me "
    "même mes moi mon ne nos notre nous on ou où par pas pour qu que qui sa se ses si son sont sur ta te tes toi ton "
    "tu un une vos votre vous c d j l à m n s t y été est suis es sommes êtes était étaient sera seront avoir ai as "
    "avons avez ont avait avaient être fait comme plus très sans sous entre donc car ni"
).split()
GERMAN_STOPWORDS = (
    "aber alle als also am an andere auch auf aus bei bin bis bist da damit dann das dass dein deine dem den der des "
    "dich die dies diese dieser dieses dir doch dort du durch ein eine einem einen einer eines er es euch für gegen "
    "hab habe haben hat hatte hatten hier hin hinter ich ihm ihn ihnen ihr ihre im in ist ja jede jeder jedes kann "
    "kein keine können man mein meine mich mir mit nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind "
    "so soll über um und uns unser unter vom von vor war waren was weil wenn wer werden wie wieder will wir wird wo zu "
    "zum zur zwischen"
).split()
SPANISH_STOPWORDS = (
    "a al algo como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era eran es esa "
    "ese eso esta estaba están este esto estos ha había han hasta hay la las le les lo los mas me mi mis mucho muy más "
    "nada ni no nos nosotros o os otra otro para pero poco por porque que quien se sea ser si sin sobre son su sus sí "
    "también tanto te tiene tienen todo todos tu tus un una uno unos y ya yo él"
).split()

STOPWORDS = {"en": ENGLISH_STOPWORDS, "id": INDONESIAN_STOPWORDS, "fr": FRENCH_STOPWORDS, "de": GERMAN_STOPWORDS,
             "es": SPANISH_STOPWORDS}

# Language profiles for stop-word based language detection: a few very common
# function words per language (own seed lists; pass a fuller table for real use).
LANGUAGE_PROFILES = {
    "en": "the and of to in is that it for was with as on be at by this are from or".split(),
    "fr": "le la les de des du et un une est en que qui dans pour pas sur au avec ce".split(),
    "de": "der die das und ist nicht ein eine zu den mit von sich auf für dem des im es".split(),
    "es": "el la los las de del y que en un una es por con para se no al lo".split(),
    "id": INDONESIAN_STOPWORDS,
}

# Sentiment seed lexicon: token -> (polarity, subjectivity). Own small list.
SENTIMENT_SEED = {
    "good": (0.7, 0.6), "great": (0.8, 0.75), "excellent": (1.0, 1.0), "best": (1.0, 0.3),
    "love": (0.5, 0.6), "happy": (0.8, 1.0), "nice": (0.6, 1.0), "wonderful": (1.0, 1.0),
    "positive": (0.23, 0.55), "fine": (0.42, 0.5), "bad": (-0.7, 0.67), "worst": (-1.0, 1.0),
    "terrible": (-1.0, 1.0), "awful": (-1.0, 1.0), "poor": (-0.4, 0.6), "hate": (-0.8, 0.9),
    "sad": (-0.5, 1.0), "wrong": (-0.5, 0.9), "negative": (-0.3, 0.4), "broken": (-0.4, 0.4),
}
