"""Sentences written by hand, none of them from the training generator, with the entities that a reader would mark. Base patterns and model together are held against them."""

import re

from tarn.llm import pii

#: ``{kind|text}`` marks an entity.
SENTENCES = """
Please write to {email|anna.schmidt@example.org} before Friday.
You can reach me at {email|jo [at] example [dot] com} most days.
My address is {email|k.lee (at) mail (dot) example (dot) net}, thanks.
Send the form to {email|office at example dot org} please.
We met at noon. It was at the old dot com building.
Mail me: {email|tim_99@sub.example.co}.
She said {email|maria(at)example(dot)org} works too.
Look at this. Dot your lines.
Contact {email|help@example.com}, {email|sales@example.com} or the desk.
Write {email|a.b+tag@example.io} or call {phone|+44 20 7946 0958}.
He arrived at example street 5.
Reply to {email|peter @ example.com} with the code.
The office line is {phone|(415) 555-1234}.
Ring {phone|415-555-1234} after six.
Call {phone|1-800-555-0199} for help.
Her cell: {phone|+1 (212) 555-0187}.
Dial {phone|0049 30 1234567} from abroad.
Our fax, {phone|415.555.9876}, is broken.
Text {phone|+49 151 23456789} tonight.
Phone {phone|(030)555-0199} and ask for Mia.
The meeting is on 2024-05-17 at 10:30.
Invoice 20240517 was paid on 17.05.2024.
In 1998-2004 the shop was closed.
It sold 1,234,567 copies in 2019.
Room 12345 is on floor 3.
The part number is 4711-0815-99.
Order 555 has 1234 lines.
Version 1.2.3 came out in 2021.
The host {ip|192.168.0.12} did not answer.
Ping {ip|10.0.0.1} and {ip|8.8.8.8} first.
Server {ip|203.0.113.77} is down again.
Section 1.2.3 of the manual explains it.
The ratio was 3.14159 to 1.
Build 300.400.500.600 is not an address.
My card is {card|4111 1111 1111 1111}.
Use {card|5500-0000-0000-0004} to pay.
The number {card|378282246310005} was charged twice.
Charge {card|4012888888881881} please.
The card {card|6011 1111 1111 1117} has expired.
Old card: {card|3530111333300000}, new one to come.
The code 1234 5678 9012 3456 is only a sample.
The serial 9876543210987654 is printed below.
ISBN 978-3-16-148410-0 is out of print.
Track 1Z999AA10123456784 online.
It took 00:12:34.5678 to finish.
Coordinates 52.5200 and 13.4050 mark the spot.
The hash da39a3ee5e6b4b0d3255bfef95601890afd80709 did not match.
Population: 83200000 in 2023.
Pay 12 500 00 in cash.
Write to {email|lea.k@example.org} or fax {phone|212-555-0143}, card {card|4242 4242 4242 4242}.
{email|first.last@example.com} is mine; {phone|+33 1 42 68 53 00} is hers.
From {ip|172.16.254.1} someone called {phone|(617) 555-0134}.
Nothing to see here.
We talked at length about dot matrix printers.
Phone numbers like 12345 are too short.
Add 3 cups, 250 g and 1000 ml.
Bus 100 leaves at 9, bus 200 at 10.
Please call {phone|(202) 555-0176} or mail {email|press at example dot com}.
The score was 21-19, 18-21, 21-17.
Backup of {ip|198.51.100.23} done, ask {email|ops@example.net}.
""".strip().split("\n")
MARK = re.compile(r"\{(\w+)\|([^}]*)\}")


def marked(line):
    """The plain sentence and its entities as (kind, start, end)."""
    text, spans, at = "", [], 0
    for m in MARK.finditer(line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def test_sentences_written_by_hand():
    assert len(SENTENCES) == 60
    right = found = gold = 0
    wrong = []
    for line in SENTENCES:
        text, want = marked(line)
        got = pii.find(text)[1]
        right, found, gold = right + len(set(got) & set(want)), found + len(got), gold + len(want)
        if set(got) != set(want):
            wrong.append((text, sorted(set(got) ^ set(want))))
    assert gold == 40
    assert right / found >= 0.9, wrong
    assert right / gold >= 0.9, wrong
