import timeit

import pytest

from lectern.llm.sentences import sentence_ends, split_sentences

# each case is a list of sentences and what joins them
CASES = [
    ([], ""),
    (["Mr. Pell came at 2.39 p.m. with No. 7.", "He left."], " "),
    (["He packed the map, a rope, etc.", "The baker came at 2 p.m.", "Dr. A. B. Cole, i.e. the new teacher, knew (see p. 9)."], " "),
    (["The train\nfrom here left.", "It was late."], "\n"),
    (["“Stop! Look!” cried Ann.", "“Who is it?”", "“Come,” said the doctor, “and see.”", "He asked, “Why?”", "The sign read “Closed. No entry.” and Bo left."], " "),
    (["He hesitated... then left.", "Why?!", "Cole (Did you hear that?) sang."], "  "),
    (["Am 3. Mai ging er fort.", "Er kaufte Salz usw. und Nr. 7, d. h. alles, z. B. Brot.", "„Komm her!“, rief der Müller."], " "),
    (["«¡Espera!», gritó Ana.", "¿Quién vio al Sr. Paz?", "Dudó... pero abrió la pág. 3."], "\n\n"),
    (["क्या वह आया?", "“बंद करो!” सोहिल ने कहा।", "डॉ. काशन ने 3.5 मीटर नापा।"], " "),
    (["“把它扔下船！”他说，校长走了。", "“冰太薄了！”", "第三天，他走了。", "他犹豫了……然后走了。", "他看到牌子上写着“关闭。禁止通行。”，只好折返。", "他（是谁？）走了。", "他回答：“好。”", "难道他走了？！"], ""),
    (["他在No.45等着Barrow & Co. 的人", "他走了", "她来了"], "\n"),
    (["他走了", "他说“好！”的时候\n下雨了", "她来了"], "　　"),
    (["A cat​.‍", "B sat."], " "),
    (["One line", "1. Second line"], "\n\n"),
    # reporting clauses of any length
    (["“走吧！”" + "非常非常" * 60 + "小心的校长" * 20 + "说，他走了。", "她来了。"], ""),
    (["“Go!” Ann\u200b" + "a" * 200 + " Bel said.", "She left."], " "),
    (["“चलो!” " + "बहुत " * 60 + "राम ने कहा।", "वह गया।"], " "),
    # levels of lists: items are apart, what one leaves open ends with it, what was open before stays open
    (["We need:", "1. (a rope", "2. the red map", "- of wood", "- of stone!", "3. “Salt. Or oil.” and bread"], "\n"),
    (["He read “the list:\n1. rope.\n2. (salt.\nThat is all.” and left.", "She slept."], " "),
    (["Years went by until\n1838. Then", "1. one", "2. two", "3. three."], "\n"),
]


@pytest.mark.parametrize("sentences,joint", CASES)
def test_cases(sentences, joint):
    want, at = [], 0
    for s in sentences:
        want.append(at + len(s.rstrip("​‍")))
        at += len(s) + len(joint)
    assert sentence_ends(joint.join(sentences)) == want


def test_line_ends_and_odd_texts():
    assert sentence_ends("A b.\r\nC d.\r\n") == [4, 10]
    assert sentence_ends(None) == sentence_ends(" \n​") == []
    assert sentence_ends("“never closed. Yet it goes on. Here.") == [14, 30, 36]
    assert len(sentence_ends("He came. " * 50_000)) == 50_000


@pytest.mark.parametrize("part", ["One. “Two!” Three 3. Four\n\n", "(", "“他走了。”", "Er ging. ", "1. a ", "\n1. a", "“Go. ", "    ", "a.b", "「好。」,"])
def test_time_grows_with_the_text(part):
    def took(n):
        text = part * n
        return min(timeit.repeat(lambda: sentence_ends(text), number=1, repeat=3))

    assert took(40_000) < 5.5 * took(10_000) + 0.1


def test_rows(spark):
    rows = [(1, "A b. C d.", "x"), (2, None, "x"), (3, "", "x"), (3, "E.", None), (3, "E.", None)]
    out = split_sentences(spark.createDataFrame(rows, "pair_id bigint, target string, sent_no string"), "pair_id", "target").collect()
    assert sorted(map(tuple, out)) == [(1, 1, 4), (1, 2, 9), (3, 1, 2), (3, 1, 2)]
